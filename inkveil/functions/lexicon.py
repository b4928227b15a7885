"""Word lists. Each is data: the order in a list says nothing, and lists are longest words first."""

from __future__ import annotations

from functools import cache
from pathlib import Path

FORMAT = 1


class LexiconError(ValueError):
    """A lexicon file that is not what it says it is."""


def parse(text: str) -> dict[str, frozenset[str]]:
    """The lists of a lexicon file: ``#!lexicon 1``, then ``#!list name count`` before each list's words.

    Lines that start with a single ``#`` are remarks. The count is of distinct words in lower case.
    """
    lists: dict[str, set[str]] = {}
    counts: dict[str, int] = {}
    version, current = None, None
    for line in text.splitlines():
        if line.startswith("#!"):
            word, *rest = line[2:].split()
            if word == "lexicon":
                version = int(rest[0])
            elif word == "list":
                current = lists.setdefault(rest[0], set())
                counts[rest[0]] = int(rest[1])
            else:
                raise LexiconError(f"unknown directive {word!r}")
        elif line.strip() and not line.startswith("#"):
            if current is None:
                raise LexiconError("words before any list")
            current.update(w.lower() for w in line.split())
    if version != FORMAT:
        raise LexiconError(f"lexicon format {version}, not {FORMAT}")
    for name, n in counts.items():
        if len(lists[name]) != n:
            raise LexiconError(f"{name}: {n} words declared, {len(lists[name])} found")
    return {k: frozenset(v) for k, v in lists.items()}


@cache
def stop_words() -> frozenset[str]:
    return parse(Path(__file__).with_name("stop_words.txt").read_text("utf-8"))["stop_words"]


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


HONORIFICS = tuple("Grandmother Grandfather Professor Principal Reverend Sergeant Grandma Grandpa Officer Captain Brother Auntie Cousin Sister Madam Uncle Nurse Coach Chief Prof Miss Capt Aunt Sir Sgt Rev Mrs Ms Mx Mr Fr Dr".split())
PARTICLES = _set("della the von van los ibn der del den bin y of le la du di de da al")
#: Particles of folded names: another list than that of running text.
KEY_PARTICLES = _set("vander saint della von van ter ten san mac les ibn dos der den del das bin ben abu st op mc le la du di de da al")
ORG_SUFFIXES = _set(
    "technologies corporation association university restaurant industries foundation department synagogue institute insurance committee "
    "hospital holdings partners airlines systems society college company council academy league agency bureau market mosque motors temple "
    "school clinic church union group store corp. team inc. club corp bank llc ltd inc co. co"
)
LANDMARK_SUFFIXES = _set(
    "planetarium observatory peninsula mountains cathedral monument mountain memorial aquarium stadium pyramid library highway gardens capitol "
    "valley temple statue palace museum island desert castle canyon bridge arena tower trail river ocean falls wall park lake zoo sea"
)
CLITICS = ("n't", "'re", "'ve", "'ll", "'s", "'m", "'d", "'t")
DETERMINERS = _set(
    "neither several another enough either these those their three other every both such each many much most that your this some few two one any its his our all her the no my an a"
)
ABBREVIATIONS = _set("prof capt sgt rev rep mrs sen hon gov gen col sr st ms mr lt jr fr dr")
RELATIONS = _set(
    "grandmother grandfather neighbours classmates babysitter bestfriend neighbors neighbour principal classmate roommate teammate neighbor coworker "
    "brothers stepmom grandma stepdad brother grandpa cousins sisters teacher friends friend mother father sister cousin uncle coach tutor boss aunt mom dad"
) | {"teammates"}
PROXIMITY = (
    "in my neighbourhood", "across the street", "in my neighborhood", "down the street", "down the block", "up the block", "at my school", "doors down",
    "in my grade", "in my class", "door down", "on my team", "next door",
)
FIRST_PERSON = _set("our us we my me i")
AMBIGUOUS_GIVEN = _set(
    "patience trinity summer mercy sunny robin grant penny miles grace faith frank brook chase wills will rose rich mark nick june jack hope drew dawn bill sky pat may joy art"
)
AMBIGUOUS_SURNAMES = _set("young white stone price moore green brown black rich king")
#: Marks that an earlier anonymiser left.
ANONYMISED = _set("ORGANIZATION LOCATION PERCENT PERSON MONTH STATE MONEY EMAIL TIME DATE CITY CAPS NUM DR")
