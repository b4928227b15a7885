"""Pages written by hand in the manner of common site builders, apart from the generator that the model learns from. Of each
page: its html, and its blocks with whether they belong to the article."""

PAGES = [
    (  # a weblog
        """<!DOCTYPE html><html lang="en"><head><title>Bread &mdash; A Kitchen Log</title><style>p{margin:0}</style></head><body class="post-template single-post">
<a class="skip-link screen-reader-text" href="#c">Skip to content</a>
<header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">A Kitchen Log</a></p></div>
<nav class="main-navigation"><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li><li><a href="/recipes">Recipes</a></li></ul></nav></header>
<div id="content" class="site-content"><main id="c"><article id="post-81" class="post type-post"><header class="entry-header"><h1 class="entry-title">Why the second rise matters</h1></header>
<div class="entry-content"><p>Most loaves fail in the last hour, not in the first. The dough has been fed and folded, and then it is put into the oven too soon.</p>
<p>Press a finger into the side: if the dent fills slowly, the loaf is ready; if it springs back at once, wait.</p>
<h2>What the cold does</h2><p>A night in the refrigerator slows the yeast, but the acids go on working, and <em>that</em> is where the taste comes from.</p>
<ul><li>Four degrees for twelve hours, covered with a damp cloth.</li><li>Back to room temperature for one hour before it is shaped.</li></ul></div></article>
<section id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on this post</h2><ol class="comment-list"><li class="comment"><p>I tried the cold rise last week and it worked very well, thank you for writing it down.</p></li>
<li class="comment"><p>Does this also hold for rye?</p></li></ol></section></main>
<aside id="secondary" class="widget-area"><section class="widget"><h2 class="widget-title">Recent Posts</h2><ul><li><a href="/1">Knives, and how to keep them</a></li></ul></section></aside></div>
<footer id="colophon" class="site-footer"><p>Proudly powered by flour. &copy; 2024 A Kitchen Log</p></footer></body></html>""",
        [
            ("Skip to content", 0), ("A Kitchen Log", 0), ("Home", 0), ("About", 0), ("Recipes", 0), ("Why the second rise matters", 1),
            ("Most loaves fail in the last hour, not in the first. The dough has been fed and folded, and then it is put into the oven too soon.", 1),
            ("Press a finger into the side: if the dent fills slowly, the loaf is ready; if it springs back at once, wait.", 1), ("What the cold does", 1),
            ("A night in the refrigerator slows the yeast, but the acids go on working, and that is where the taste comes from.", 1),
            ("Four degrees for twelve hours, covered with a damp cloth.", 1), ("Back to room temperature for one hour before it is shaped.", 1), ("2 thoughts on this post", 0),
            ("I tried the cold rise last week and it worked very well, thank you for writing it down.", 0), ("Does this also hold for rye?", 0), ("Recent Posts", 0), ("Knives, and how to keep them", 0),
            ("Proudly powered by flour. © 2024 A Kitchen Log", 0),
        ],
    ),
    (  # a newspaper, tables of divisions with telling names only
        """<html><body><div class="topbar"><div class="wrap"><span>Tuesday edition</span> <a href="/login">Sign in</a></div></div>
<div class="cookie-consent-banner" role="dialog"><p>We and our partners store information on your device. You may refuse.</p><button>Accept</button></div>
<div class="page"><div class="breadcrumb"><a href="/">News</a> <a href="/city">City</a></div>
<div class="story"><h1>Council votes to reopen the eastern bridge</h1><div class="byline">By our reporter in the city hall</div>
<div class="story-body"><p>After six years of repairs the council decided on Monday that the bridge will carry trams again, if only at night.</p>
<div class="ad-slot" id="ad-2"><p>Advertisement: buy two tyres, get the third for half.</p></div>
<p>&ldquo;We have waited long enough,&rdquo; said the head of the board, who had argued against the plan in spring.</p>
<blockquote><p>No one who lives on the island wants to walk for an hour in the rain.</p></blockquote>
<div class="related-stories"><h3>Read more</h3><ul><li><a href="/a">Trams return to the harbour</a></li><li><a href="/b">What the repairs have cost so far</a></li></ul></div>
<p>Work on the rails begins in March and should end before the first snow falls.</p></div></div>
<div class="newsletter-signup"><h4>Our letter</h4><p>All that matters, each morning in your inbox.</p><form><input type="email"><button>Subscribe</button></form></div></div>
<div class="footer"><p>All rights reserved.</p><a href="/imprint">Imprint</a></div></body></html>""",
        [
            ("Tuesday edition Sign in", 0), ("We and our partners store information on your device. You may refuse.", 0), ("Accept", 0), ("News City", 0), ("Council votes to reopen the eastern bridge", 1),
            ("After six years of repairs the council decided on Monday that the bridge will carry trams again, if only at night.", 1), ("Advertisement: buy two tyres, get the third for half.", 0),
            ("“We have waited long enough,” said the head of the board, who had argued against the plan in spring.", 1), ("No one who lives on the island wants to walk for an hour in the rain.", 1),
            ("Read more", 0), ("Trams return to the harbour", 0), ("What the repairs have cost so far", 0), ("Work on the rails begins in March and should end before the first snow falls.", 1),
            ("Our letter", 0), ("All that matters, each morning in your inbox.", 0), ("Subscribe", 0), ("All rights reserved. Imprint", 0), ("All rights reserved.", 0), ("Imprint", 0),
        ],
    ),
    (  # documentation
        """<body><nav class="navbar"><a class="brand" href="/">libfoo</a><a href="/docs">Docs</a></nav><div class="layout"><div class="sidebar"><ul><li><a href="#i">Install</a></li><li><a href="#u">Usage</a></li></ul></div>
<main role="main"><div class="document"><h1>Reading archives</h1><p>An archive is opened with <code>open_archive</code>, which returns a reader that must be closed.</p>
<pre>with open_archive(path) as reader:
    for record in reader:
        print(record)</pre><p>Records come in the order in which they were written. A damaged record raises an error that names its offset.</p>
<table><tr><th>Option</th><th>Meaning of the option</th></tr><tr><td>strict</td><td>Stop at the first record that is damaged, and say where it is.</td></tr></table></div></main></div>
<footer><p>Built with a static generator.</p></footer></body>""",
        [
            ("libfooDocs", 0), ("Install", 0), ("Usage", 0), ("Reading archives", 1), ("An archive is opened with open_archive, which returns a reader that must be closed.", 1),
            ("with open_archive(path) as reader: for record in reader: print(record)", 1), ("Records come in the order in which they were written. A damaged record raises an error that names its offset.", 1),
            ("Option", 1), ("Meaning of the option", 1), ("strict", 1), ("Stop at the first record that is damaged, and say where it is.", 1), ("Built with a static generator.", 0),
        ],
    ),
    (  # names that say little
        """<html><body><div id="hd"><div class="logo">Hillside Walkers</div><ul class="menu"><li><a href="/">Start</a></li><li><a href="/walks">Walks</a></li></ul></div>
<div id="bd"><div class="col1"><h2>The long way round the lake</h2><p>Start at the old mill and keep the water on your left. After two miles the path climbs through birches to a bench with a view.</p>
<p>In wet weather take the road instead, because the planks are slippery and there is no rail.</p><p>Allow four hours, with a rest.</p></div>
<div class="col2"><div class="sponsor"><p>Boots from Miller &amp; Sons, 20% off this month only!</p></div><div class="share"><a href="#">Tweet</a> <a href="#">Mail</a></div></div></div>
<div id="ft">&copy; Hillside Walkers | <a href="/contact">Contact</a></div></body></html>""",
        [
            ("Hillside Walkers", 0), ("Start", 0), ("Walks", 0), ("The long way round the lake", 1),
            ("Start at the old mill and keep the water on your left. After two miles the path climbs through birches to a bench with a view.", 1),
            ("In wet weather take the road instead, because the planks are slippery and there is no rail.", 1), ("Allow four hours, with a rest.", 1),
            ("Boots from Miller & Sons, 20% off this month only!", 0), ("Tweet Mail", 0), ("© Hillside Walkers | Contact", 0),
        ],
    ),
]
