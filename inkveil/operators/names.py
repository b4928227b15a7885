"""Names in running text: candidate spans, what speaks for and against them, and the verdict on each.

A document is scanned once into tokens; everything else is asked of that scan. The gazetteer comes as a table and goes to
the tasks as one broadcast of folded keys, behind a check of its size; beyond it :func:`keys` and a join serve each
document its own keys. Greedy left-to-right claims (longest title, lower-case reach) and the numbering from the right
depend on what was claimed before, which no built-in operator expresses, so this one operator works on Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np

from inkveil.functions.fold import fold
from inkveil.functions.lexicon import (
    ABBREVIATIONS,
    CLITICS,
    DETERMINERS,
    FIRST_PERSON,
    HONORIFICS,
    KEY_PARTICLES,
    LANDMARK_SUFFIXES,
    ORG_SUFFIXES,
    PARTICLES,
    PROXIMITY,
    RELATIONS,
    stop_words,
)

TIERS = ("full", "short", "place", "given", "title", "demonym", "settlement")
BIT = {t: 1 << k for k, t in enumerate(TIERS)}
#: The bit of what a title may begin with, in packed keys.
BEGINS = 1 << len(TIERS)
#: Tiers that a relation of the writer overrides.
OVERRIDABLE = ("title", "full_name", "demonym")
MOST_TITLE, LEAST_LOWER, ALL_CAPS_RUN, HEADING, WINDOW = 8, 2, 3, 60, 90

_TOKEN = re.compile(r"[A-Za-z][A-Za-z'’-]*")
_LOWER = re.compile(r"\b[a-z][a-z'’-]*")
_CAPITAL = r"[A-Z][A-Za-z'’]*(?:-[A-Z][A-Za-z'’]*)*"
_NAME = re.compile(rf"\b(?=[A-Z])(?:(?:{'|'.join(HONORIFICS)})\.?\s+)?(?:[A-Z]\.\s*)*{_CAPITAL}(?:\s+(?:(?:{'|'.join(sorted(PARTICLES))})\s+)?{_CAPITAL})*")
_MARKED = re.compile(r"\{\w*\}|@[A-Za-z]+\d*", re.A)
_OPENING = re.compile(r"(?:\A|\n+|[.!?][\"'’”)]*\s+|(?:\A|(?<=\s))[\"'‘“](?=[A-Za-z]))\s*")
_BEFORE_DOT = re.compile(r"([A-Za-z]+)\.\s*\Z")
_MID_CAPITAL = re.compile(r"(?<=[a-z,;:]\s)[A-Z][a-z]{2,}")
_LOWER_OPENING = re.compile(r"(?:\A|(?<=[.!?]\s))\s*[a-z]")
_SMALL_I = re.compile(r"\bi\b")
_UNIT = re.compile(r"[^.!?]+[.!?]*")
_RELATION = "|".join(sorted(RELATIONS))
_LED = rf"(?:my|our)\s+(?:[a-z][a-z'’-]*\s+){{0,2}}(?:{_RELATION})"
_LED_BEFORE, _LED_AFTER, _LED_TITLE = re.compile(rf"\b{_LED}\s+$"), re.compile(rf"\s*,\s*(?:who\s+(?:was|is)\s+)?{_LED}\b"), re.compile(rf"{_LED}\b")
_TAILS = tuple(f for tail in CLITICS for f in (tail, tail.replace("'", "’")))
_CLAUSE_END = re.compile(r"[\n.!?]")
_WORD = re.compile(r"\S+")
_SHORT = tuple(ABBREVIATIONS)
_LONGEST_SHORT = max(map(len, _SHORT))
_CURLY = str.maketrans("’‘ʼ′", "''''")


class _Memo(dict):
    """What a function says of words, kept for the next texts."""

    def __init__(self, of: Callable[[str], bool]):
        self.of = of

    def __missing__(self, word: str) -> bool:
        if len(self) > 1 << 17:
            self.clear()
        self[word] = out = self.of(word)
        return out


class PackedKeys:
    """Keys with bits in a few buffers, for ``get`` alone: some 30 bytes a key where a dict takes 200. Keys lie in buckets by
    their checksum, and are compared in full."""

    def __init__(self, blob: bytes, buckets: bytes, begins: bytes, ends: bytes, bits: bytes):
        self.blob, self.bits = blob, bits
        kind = "I" if len(blob) < 1 << 32 else "Q"
        self.buckets, self.begins, self.ends = (memoryview(x).cast(kind) for x in (buckets, begins, ends))
        self.shift = 32 - (len(self.buckets) - 1).bit_length() + 1

    @staticmethod
    def pack(blob: bytes, lengths: np.ndarray, sums: np.ndarray, bits: np.ndarray) -> tuple[bytes, ...]:
        """The arguments from the keys one after the other, their lengths in bytes, checksums and bits."""
        power = max(1, min(31, len(lengths).bit_length()))
        kind = np.uint32 if len(blob) < 1 << 32 else np.uint64
        ends = np.cumsum(lengths, dtype=kind)
        order = np.argsort(sums, kind="stable")
        buckets = np.searchsorted(sums[order] >> np.uint32(32 - power), np.arange((1 << power) + 1), "left").astype(kind)
        return blob, buckets.tobytes(), (ends - lengths.astype(kind))[order].tobytes(), ends[order].tobytes(), bits[order].astype(np.uint8).tobytes()

    def get(self, key: str, default: int = 0) -> int:
        raw = key.encode("utf-8", "surrogatepass")
        bucket = crc32(raw) >> self.shift
        for k in range(self.buckets[bucket], self.buckets[bucket + 1]):
            if self.blob[self.begins[k] : self.ends[k]] == raw:
                return self.bits[k]
        return default


class Gazetteer:
    """Folded keys with the tiers that list them, as bits. Packed keys hold what titles begin with under ``BEGINS``."""

    def __init__(self, keys: dict[str, int] | PackedKeys):
        self.keys = keys
        self.prefixes = () if isinstance(keys, PackedKeys) else {" ".join(parts[:n]) for k, bits in keys.items() if bits & BIT["title"] for parts in [k.split(" ")] for n in range(1, len(parts))}
        self.begins_title, self.begins_name = _Memo(self.title_prefix), _Memo(lambda w: self.given(w) and not is_stop(w))

    def has(self, name: str, tier: str) -> bool:
        return bool(self.keys.get(fold(name), 0) & BIT[tier])

    def title(self, name: str) -> bool:
        key = fold(name)
        return " " in key and bool(self.keys.get(key, 0) & BIT["title"])

    def title_prefix(self, key: str) -> bool:
        return key in self.prefixes or bool(self.keys.get(key, 0) & (BIT["title"] | BEGINS))

    def given(self, token: str) -> bool:
        key = fold(token)
        return " " not in key and bool(self.keys.get(key, 0) & BIT["given"])

    def tier(self, name: str) -> str:
        """The first tier that makes a name notable: places, then by length short forms, demonyms, full names, titles."""
        key = fold(name)
        bits, parts = self.keys.get(key, 0), key.split()
        if bits & BIT["place"]:
            return "place"
        if len(parts) <= 1:
            return "iconic_short" if bits & BIT["short"] else "demonym" if bits & BIT["demonym"] else "not_notable"
        if bits & BIT["short"] and len(parts) <= 3 and parts[0] in KEY_PARTICLES:
            return "iconic_short"
        return "full_name" if bits & BIT["full"] else "title" if bits & BIT["title"] else "not_notable"


@dataclass(frozen=True)
class Options:
    """What is switched on. ``identity`` level looks for no names but the writer's; ``gazetteer`` leaves out the
    lower-case route and the check of unevidenced capitals."""

    level: str = "gazetteer-lowercase"
    numbered: bool = True
    corroborate: bool = True
    headings: bool = True
    relation_refusal: bool = True
    title_relation_refusal: bool = True
    topical: frozenset[str] = field(default_factory=frozenset)


def without_clitic(word: str) -> str:
    if "'" in word or "’" in word:
        for form in _TAILS:
            if word.endswith(form) and len(word) > len(form):
                return word.removesuffix(form)
    return word


@lru_cache(1 << 16)
def is_stop(token: str) -> bool:
    return without_clitic(token.lower().strip(".,")).strip("'’") in stop_words()


def meets(start: int, end: int, ranges: Iterable[tuple[int, int]]) -> bool:
    return any(start < b and a < end for a, b in ranges)


def kind_of(tokens: list[str], gaz: Gazetteer | None) -> tuple[str, bool]:
    """``(kind, is masked)`` by the first that holds: a town, an organisation's ending, a landmark's ending, a person."""
    last = tokens[-1].lower().strip(".,") if tokens else ""
    if gaz and tokens and gaz.has(" ".join(tokens), "settlement"):
        return "LOCATION", True
    if last in ORG_SUFFIXES:
        return "ORGANIZATION", True
    return "NAME", not (len(tokens) > 1 and last in LANDMARK_SUFFIXES)


def headings(text: str) -> list[tuple[int, int]]:
    out, at, after_blank = [], 0, True
    for line in text.split("\n"):
        bare = line.strip()
        if bare and after_blank and len(bare) < HEADING and bare[-1] not in "?!.":
            out.append((at, at + len(line)))
        after_blank, at = not bare, at + len(line) + 1
    return out


def openings(text: str) -> set[int]:
    """Where sentences start: not after a title's abbreviation."""
    out = set()
    for m in _OPENING.finditer(text):
        begin, end = m.span()
        if text[max(0, begin - _LONGEST_SHORT) : begin].lower().endswith(_SHORT):
            word = _BEFORE_DOT.search(text, max(0, end - 64), end)
            if word and word[1].lower() in ABBREVIATIONS:
                continue
        out.add(end)
    return out


def habit(text: str, heads: list[tuple[int, int]]) -> str:
    """How the writer capitalises: consistent, inconsistent, lowercase or silent."""
    marks = sum(not meets(m.start(), m.end(), heads) for m in _MID_CAPITAL.finditer(text))
    low = sum(1 for _ in _LOWER_OPENING.finditer(text))
    small = _SMALL_I.search(text) is not None
    if marks < 2:
        return "lowercase" if small or low else "silent"
    units = sum(1 for m in _UNIT.finditer(text) if m[0].strip())
    return "inconsistent" if small or low >= 0.10 * max(1, units) else "consistent"


class Scan:
    """One document's tokens and what follows from them."""

    def __init__(self, text: str, options: Options, gaz: Gazetteer | None):
        self.text, self.options, self.gaz = text, options, gaz
        self.tokens = [(*m.span(), m[0]) for m in _TOKEN.finditer(text)]
        self.begun = [k for k, t in enumerate(self.tokens) if t[2][0] <= "Z"]  # tokens begin with an ASCII letter
        self.heads = headings(text) if options.headings else []
        self.openings = openings(text)
        self.habit = habit(text, self.heads)
        self.marks_names = self.habit in ("consistent", "inconsistent")
        self.emphasis = self._emphasis()
        self.capitals = {
            w.lower().strip("'’") for a, b, w in map(self.tokens.__getitem__, self.begun)
            if a not in self.openings and not (len(w) > 1 and w.isupper()) and not meets(a, b, self.heads)
        }
        self.blocked = [m.span() for m in _MARKED.finditer(text)]
        if gaz:
            self.blocked += [t for t in self.titles() if not (options.title_relation_refusal and self._refused(*t))]

    def _emphasis(self) -> list[tuple[int, int]]:
        """Runs of capitals too short to be shouting."""
        out, run, last = [], [], -2
        for k in [*self.begun, -1]:
            a, b, w = self.tokens[k] if k >= 0 else (0, 0, "")
            loud = len(w) > 1 and w.isupper()
            if run and not (loud and k == last + 1):
                if len(run) < ALL_CAPS_RUN:
                    out.append((run[0][0], run[-1][1]))
                run = []
            if loud:
                run.append((a, b))
                last = k
        return out

    def titles(self) -> list[tuple[int, int]]:
        """Leftmost, longest titles of two to eight tokens that don't overlap. Only words that begin some title are looked at."""
        words = "\n".join([w for _, _, w in self.tokens]).lower().translate(_CURLY).split("\n") if self.tokens else []
        begins = self.gaz.begins_title
        firsts = {w for w in set(words) if begins[w]}
        out, past = [], 0
        for k in [k for k, w in enumerate(words) if w in firsts] if firsts else ():
            begin, best = self.tokens[k][0], 0
            if k >= past and (not self.marks_names or self.text[begin].isupper()):
                for n in range(1, min(MOST_TITLE, len(words) - k) + 1):
                    if n > 1 and self.gaz.title(self.text[begin : self.tokens[k + n - 1][1]]):
                        best = n
                    if not self.gaz.title_prefix(" ".join(words[k : k + n])):
                        break
            if best:
                out.append((begin, self.tokens[k + best - 1][1]))
                past = k + best
        return out

    def _refused(self, start: int, end: int) -> bool:
        """A title that is rather someone the writer knows."""
        if self.attached(start, end):
            return True
        span = self.text[start:end]
        words = _TOKEN.findall(span)
        lower_inside = any(w.islower() for w in words[1:3])
        mixed = len(words) > 1 and words[-1][0].isupper() and lower_inside
        return (self.marks_names or mixed) and lower_inside and _LED_TITLE.match(span.lower()) is not None

    def _around(self, start: int, end: int) -> tuple[str, str, str]:
        after = self.text[end : end + WINDOW].lower()
        return self.text[max(0, start - WINDOW) : start].lower(), after, _CLAUSE_END.split(after, maxsplit=1)[0]

    def attached(self, start: int, end: int) -> bool:
        """Whether the writer says the span is a relation of theirs."""
        before, after, clause = self._around(start, end)
        if _LED_BEFORE.search(before) or _LED_AFTER.match(after):
            return True
        return after.lstrip().startswith(",") and any(p in clause for p in PROXIMITY) and not FIRST_PERSON.isdisjoint(_TOKEN.findall(clause))

    def in_writers_life(self, start: int, end: int) -> bool:
        before, _, clause = self._around(start, end)
        return any(any(p in w for p in PROXIMITY) or not RELATIONS.isdisjoint(_TOKEN.findall(w)) for w in (clause, before))

    def _evidence(self, words: list[str]) -> bool:
        for w in words:
            bare = w.lower().strip(".,'’")
            if any(x in self.capitals or self.gaz.given(x) for x in {bare, without_clitic(bare)}):
                return True
        return False

    def _only_a_capital(self, words: list[str], start: int) -> bool:
        end = start + len(" ".join(words))
        if meets(start, end, self.heads):
            return True
        return len(words) == 1 and (start in self.openings or meets(start, end, self.emphasis))

    def capitalised(self) -> list[tuple[int, int, str]]:
        """``(start, end, kind)`` by the route of capitals: matches cut at stop words, kept if more than a capital speaks
        for them. Of equal runs in a match each has its own place; a run broken by more than one space is dropped."""
        out = []
        for m in _NAME.finditer(self.text):
            if meets(m.start(), m.end(), self.blocked):
                continue
            words = [(m.start() + w.start(), w[0]) for w in _WORD.finditer(m[0])]
            stop = [is_stop(w) for _, w in words]
            runs, run = [], []
            for k, item in enumerate(words):
                leads = stop[k] and item[1].lower().strip(".,") in _HONORIFIC_WORDS and k + 1 < len(words) and not stop[k + 1]
                if stop[k] and not leads:
                    runs.append(run)
                    run = []
                else:
                    run.append(item)
            for run in filter(None, [*runs, run]):
                parts, start = [w for _, w in run], run[0][0]
                joined = " ".join(parts)
                end = start + len(joined)
                if self.text[start:end] != joined or meets(start, end, self.blocked):
                    continue
                if self.lower_route and self._only_a_capital(parts, start) and not self._evidence(parts):
                    continue
                shown = joined.rstrip("'’")
                if shown:
                    out.append((start, start + len(shown), kind_of(parts, self.gaz)[0]))
        return out

    @property
    def lower_route(self) -> bool:
        return self.gaz is not None and self.options.level == "gazetteer-lowercase"

    def lower_case(self) -> list[tuple[int, int, str]]:
        """``(start, end, kind)`` by the route of lower case: a given name that reaches on over particles."""
        begins = self.gaz.begins_name
        given = {w for w in set(_LOWER.findall(self.text)) if begins[w]}
        if not given:
            return []
        toks = [(*m.span(), m[0]) for m in _LOWER.finditer(self.text)]
        gap = lambda k: self.text[toks[k][1] : toks[k + 1][0]]
        out, past = [], 0
        for k, (start, _, word) in enumerate(toks):
            if word not in given or k < past:
                continue
            skip = k and toks[k - 1][2] in DETERMINERS and gap(k - 1).isspace()
            last = k
            while not skip and last + 1 < len(toks) and (last == k or toks[last][2] in PARTICLES):
                following = toks[last + 1][2]
                if not gap(last).isspace() or len(following) < 2 or is_stop(following):
                    break
                last += 1
            while last > k and toks[last][2] in PARTICLES:
                last -= 1
            end = toks[last][1]
            named = self.habit == "lowercase" or any(w.strip("'’") in self.capitals for _, _, w in toks[k : last + 1])
            if skip or last - k + 1 < LEAST_LOWER or meets(start, end, self.blocked) or not named:
                continue
            out.append((start, end, kind_of(self.text[start:end].split(), self.gaz)[0]))
            past = last + 1
        return out

    def candidates(self) -> list[tuple[int, int, str]]:
        found = self.capitalised()
        if self.lower_route:
            found += [c for c in self.lower_case() if not meets(c[0], c[1], [f[:2] for f in found])]
        return found


_HONORIFIC_WORDS = frozenset(h.lower() for h in HONORIFICS)


def surname_words(name: str) -> list[str]:
    out = []
    for w in name.translate(_CURLY).lower().split():
        w = w.strip(".,;:!?'\"")
        out.append(w[:-2] if w.endswith("'s") and len(w) > 3 else w)
    return [w for w in out if w]


def bare_key(name: str) -> str | None:
    """The name as a bare surname: one word, or up to three led by particles."""
    words = surname_words(name)
    if len(words) == 1 or (2 <= len(words) <= 3 and PARTICLES.issuperset(words[:-1])):
        return " ".join(words)
    return None


def surname_forms(name: str) -> list[str]:
    """The forms by which a full name's surname may come back."""
    words = surname_words(name)
    out = words[-1:] if len(words) > 1 else []
    for n in (2, 3):
        if len(words) < n or words[-n] not in PARTICLES:
            break
        out.append(" ".join(words[-n:]))
    return out


def _establishes(name: str, keep: frozenset[str], gaz: Gazetteer) -> bool:
    return len(name.split()) > 1 and (name.lower() in keep or gaz.tier(name) == "full_name")


def verdicts(text: str, options: Options, gaz: Gazetteer | None, keep: frozenset[str] = frozenset()) -> tuple[Scan, list[dict]]:
    """Every candidate of a document with its verdict and the reason, in text order.

    Relations are read from the text as the structured pass left it, not from one already being rewritten.
    """
    keep = frozenset(k.lower() for k in keep | options.topical)
    scan = Scan(text, options, gaz)
    found = scan.candidates()
    names = {c: text[c[0] : c[1]] for c in found}
    established = {f for n in names.values() if _establishes(n, keep, gaz) for f in surname_forms(n)} if options.corroborate and gaz else set()
    out = []
    for c in found:
        name, tier = names[c], gaz.tier(names[c]) if gaz else "not_notable"
        reason = "absent"
        if name.lower() in keep or " ".join(surname_words(name)) in keep:
            reason = "topical"
        elif not kind_of(name.split(), gaz)[1]:
            reason = "landmark"
        elif tier != "not_notable" and not (options.title_relation_refusal and tier in OVERRIDABLE and scan.attached(*c[:2])):
            reason = tier
        elif bare_key(name) in established and not (options.relation_refusal and scan.in_writers_life(*c[:2])):
            reason = "established"
        out.append({"text": name, "start": c[0], "end": c[1], "kind": c[2], "tier": tier, "mask": reason == "absent", "reason": reason})
    return scan, out


def mask(text: str, minted: list[tuple[str, int, str]], options: Options, gaz: Gazetteer | None, keep: frozenset[str] = frozenset()) -> tuple[str, list[tuple[str, int, str]], int, str, list[dict]]:
    """``(text, minted, replaced, habit, spans)``; numbers are given from the right, equal starts in order of discovery."""
    scan, spans = verdicts(text, options, gaz, keep)
    known = {(k, o): i for k, i, o in minted}
    top: dict[str, int] = {}
    for k, i, _ in minted:
        top[k] = max(i, top.get(k, 0))
    n = 0
    for s in sorted(spans, key=lambda s: -s["start"]):
        if not s["mask"]:
            continue
        place = (s["kind"], s["text"])
        if options.numbered and place not in known:
            known[place] = top[s["kind"]] = top.get(s["kind"], 0) + 1
        mark = f"{{{s['kind']}_{known[place]}}}" if options.numbered else f"{{{s['kind']}}}"
        text = text[: s["start"]] + mark + text[s["end"] :]
        n += 1
    return text, [(k, i, o) for (k, o), i in known.items()], n, scan.habit, sorted(spans, key=lambda s: s["start"])


def established_tokens(text: str, options: Options, gaz: Gazetteer) -> frozenset[str]:
    """Words of notable full names that a text sets up: what its feedback may repeat in the clear."""
    plain = Scan(text, options, None)
    keep, out = frozenset(t.lower() for t in options.topical), set()
    for a, b, _ in plain.candidates():
        if _establishes(text[a:b], keep, gaz):
            out.update(w for w in surname_words(text[a:b]) if len(w) > 1 and w not in PARTICLES)
    return frozenset(out)


def carried_keeps(text: str, options: Options, gaz: Gazetteer | None, own_names: Iterable[str] = ()) -> frozenset[str]:
    """Established words, less those of private people the text names and of the writer."""
    if gaz is None:
        return frozenset()
    keep = established_tokens(text, options, gaz)
    if not keep:
        return keep
    private = set()
    for a, b, _ in Scan(text, options, None).candidates():
        words = text[a:b].lower().split()
        if len(words) > 1 and gaz.tier(text[a:b]) == "not_notable":
            private.update(words)
    for name in own_names:
        private.update(name.lower().split())
    return keep - private
