"""Scores of abusive, hateful and sexual language, with misspelled and disguised terms.

The lexicon lists words and stems by the part they play: insults, commands, threats, acts, groups and so on. Terms are
met by Levenshtein automata run along the lexicon's trie over a folded form of each sentence (width, case, kana, digits
and look-alike letters for letters, nothing between letters), one edit for longer terms, a masked letter for shorter
ones. A window of context then decides: around each leading term the weights of the parts in its neighbourhood add up,
each part by its most telling terms, so no word alone makes a case but a company of parts does.

Quotation is separated from abuse by its own window: what stands between quotation marks next to a word of mention, or
right beside "the word", counts a fifth; an insult that its writer turns on himself counts half; hate needs a group in
reach. Longer harmless words (an albatross, a naked bulb) take the terms inside them out, and nothing else.

A document scores as its highest window; it is a case from `THRESHOLD` on.

Defined results: null, empty and blank texts score 0; texts of any length are read whole; repeats score alike.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import lexicon as lex
from corpusloom.llm.automata import Trie
from corpusloom.llm.lookalikes import SAME_SHAPE
from corpusloom.operators.bounded import spread

THRESHOLD = 1.0
#: What counts of a quoted term next to a word of mention, of an insult turned on oneself, and of hate without a group.
QUOTED, ONESELF, NO_GROUP = 0.2, 0.5, 0.9
#: Letters on either side of a leading term within which other terms keep it company.
WINDOW = 48
CLASSES = ("abuse", "hate", "sexual")

_LEET = str.maketrans("013457@$", "oieastas")
_MIXED = re.compile(r"[a-z]*(?:[0-9@$][a-z]+|[a-z]+[0-9@$])[a-z0-9@$]*")
_DIGIT = re.compile(r"[0-9@$]")
_ONE = {c: c - 96 for c in range(0x30A1, 0x30F7)} | {ord(c): "○" for c in "〇●×＊*"}
# letters of other scripts and with marks that pass for Latin ones
_ONE |= {ord(c): group[0] for group in SAME_SHAPE if group[0].isascii() and group[0].islower() for c in group[1:]}
_ONE |= {c: d[0].lower() for c in range(0xC0, 0x250) if (d := unicodedata.normalize("NFD", chr(c))) != chr(c) and d[0].isascii()}
_REST = re.compile(r"[^\w○]|_")
_TAG = re.compile(r"</?[a-z][^>]*>|&[a-z]+;|&#\d+;", re.I)
_END = r"[。！？!?\n\r]+|(?<=[a-z])[.．](?=\s|$)"
_QUOTATION = r"「[^「」\n]*」|『[^『』\n]*』|“[^“”\n]*”|\"[^\"\n]*\""
_SENTENCE = re.compile(_END, re.I)
_TOKENS = re.compile(f"({_QUOTATION})|({_END})", re.I)
_QUOTES = re.compile(f"({_QUOTATION})")
_LATIN_SUFFIXES = {"", "s", "es", "ed", "d", "ing", "ting", "ning", "er", "ers", "ly", "y", "ish", "in", "r"}
_GROUP = re.compile(r"[人者](?:[はがをにのとも]|お断|なんて|ども)")
_SPOKEN_OF = re.compile(r".{0,1}(?:という言葉|という語|って言葉|という表現|という名|という題)")
_WORD_OF = re.compile(r"(?:theword|thephrase|theterm)$")


def _lean(text: str) -> str:
    s = text.lower()
    return _MIXED.sub(lambda m: m.group().translate(_LEET), s) if _DIGIT.search(s) else s


def folded(text: str) -> str:
    """One form of a sentence: only letters stay, all in one width, case and kana, digits in words as the letters they stand for."""
    return _REST.sub("", _lean(unicodedata.normalize("NFKC", text)).translate(_ONE)).strip("○")


def sentences(text: str) -> list[str]:
    """The sentences of a text, markup between them taken for a break; a quotation belongs whole to its sentence."""
    out: list[str] = []
    for line in _TAG.sub("\n", unicodedata.normalize("NFKC", text)).splitlines():
        if not _QUOTES.search(line):
            out += _SENTENCE.split(line)
            continue
        begin = 0
        for m in _TOKENS.finditer(line):
            if m.group(2) is not None:
                out.append(line[begin : m.start()])
                begin = m.end()
        out.append(line[begin:])
    return [s for s in out if s and not s.isspace()]


class Hit(NamedTuple):
    start: int
    end: int
    part: str
    term: str
    weight: float


class Folded:
    """A sentence in folded form, with the places where something was left out, its katakana and its mentions."""

    def __init__(self, text: str) -> None:
        letters: list[str] = []
        self.gaps: set[int] = {0}
        self.katakana: set[int] = set()
        self.mentions: list[tuple[int, int]] = []
        pieces = _QUOTES.split(text)
        spans: list[tuple[int, int]] = []
        for i, piece in enumerate(pieces):
            begin = len(letters)
            self.gaps.add(begin)
            for c in _lean(piece):
                one = c.translate(_ONE)
                if _REST.match(one):
                    self.gaps.add(len(letters))
                    continue
                if "ァ" <= c <= "ヺ" or c == "ー":
                    self.katakana.add(len(letters))
                letters.append(one)
            if i % 2:
                spans.append((begin, len(letters)))
        self.text = "".join(letters)
        self.gaps.add(len(letters))
        #: A sentence without any hiragana is written in katakana throughout.
        self.plain_katakana = not re.search("[ぁ-ゖ]", text)
        for a, b in spans:
            before, after = self.text[max(0, a - 8) : a], self.text[b : b + 12]
            if any(before.endswith(w) for w in _BEFORE) or any(after.startswith(w) for w in _AFTER):
                self.mentions.append((a, b))

    def whole_word(self, start: int, end: int) -> bool:
        """Whether a Latin term stands for itself, inflected at most."""
        f = self.text
        if start not in self.gaps and f[start - 1 : start].isascii() and f[start - 1].isalpha():
            return False
        at = end
        while at < len(f) and at not in self.gaps and f[at].isascii() and f[at].isalpha():
            at += 1
            if at - end > 4:
                return False
        return f[end:at] in _LATIN_SUFFIXES

    def short_kana(self, start: int, end: int) -> bool:
        """Whether a term of two or three kana stands for itself and not inside another word."""
        if self.plain_katakana or any(g in self.gaps for g in range(start + 1, end)):
            return True
        f = self.text
        left, right = start in self.gaps, end in self.gaps
        if start in self.katakana:
            return (left or start - 1 not in self.katakana) and (right or end not in self.katakana)
        return (left or f[start - 1] in "のはがもをにとよろせけれめえなてだ") and (right or f[end] in "だのはがどもらみぶばをにとかなしでん")


_BEFORE = [folded(w) for w in lex.MENTION_BEFORE]
_AFTER = [folded(w) for w in lex.MENTION_AFTER]
_SELF = [folded(w) for w in lex.SELF]
_LONGEST = max(len(folded(w)) for w in lex.NEUTRAL)
_INHERENT = {folded(w) for w in lex.INHERENT}


def bound(term: str) -> int:
    """Edits allowed for a folded term."""
    return int(len(term) >= (7 if term.isascii() else 6))


def spellings(term: str) -> list[str]:
    """A term and its forms with one or all of its ideographs in kana, folded."""
    out = [term]
    known = [c for c in dict.fromkeys(term) if c in lex.READINGS]
    out += [term.replace(c, lex.READINGS[c]) for c in known]
    if len(known) > 1:
        out.append("".join(lex.READINGS.get(c, c) for c in term))
    return list(dict.fromkeys(folded(x) for x in out))


class Lexicon:
    """The trie of leading terms, a filter for it, and the automata of the terms that keep them company.

    A term within one edit holds one of its halves unchanged, so the Levenshtein automaton starts only where a half says
    that a term may begin.
    """

    def __init__(self) -> None:
        self.trie = Trie()
        self.filter = ahocorasick.Automaton()
        self.company = ahocorasick.Automaton()
        self.neutral = ahocorasick.Automaton()
        self.memory: dict[str, tuple[float, float, float]] = {}
        halves: dict[str, set[int]] = {}
        company: dict[str, set[str]] = {}
        for part, terms in lex.TERMS.items():
            leading = part in lex.LEADING
            for term in terms:
                for f in spellings(term) if leading else [folded(term)]:
                    if not leading:
                        company.setdefault(f, set()).add(part)
                        continue
                    self.trie.add(f, (part, folded(term), f))
                    cut = len(f) // 2 if bound(f) else 0
                    for offset, half in ((0, f),) if not cut else ((0, f[:cut]), (cut, f[cut:])):
                        halves.setdefault(half, set()).add(offset)
        for half, offsets in halves.items():
            self.filter.add_word(half, (len(half), tuple(offsets)))
        for f, parts in company.items():
            self.company.add_word(f, (len(f), tuple(sorted(parts)), f))
        for term in lex.NEUTRAL:
            self.neutral.add_word(folded(term), len(folded(term)))
        for a in (self.filter, self.company, self.neutral):
            a.make_automaton()

    def sentence(self, text: str) -> tuple[float, float, float]:
        """Scores (abuse, hate, sexual) of one sentence."""
        known = self.memory.get(text)
        if known is None:
            known = self._sentence(text)
            if len(self.memory) > 200_000:
                self.memory.clear()
            self.memory[text] = known
        return known

    def _sentence(self, text: str) -> tuple[float, float, float]:
        f = folded(text)
        masked = "○" in f
        if not masked and next(self.filter.iter(f), None) is None:
            return (0.0, 0.0, 0.0)
        s = Folded(text)
        f = s.text
        if masked:
            starts = set(range(len(f)))
        else:
            starts = {max(0, end - n + 1 - offset + slip) for end, (n, offsets) in self.filter.iter(f) for offset in offsets for slip in (-1, 0, 1)}
        return self.scores(s, self._hits(s, sorted(starts), masked))

    def _hits(self, s: Folded, starts: list[int], masked: bool) -> list[Hit]:
        f = s.text
        covered: dict[int, int] = {}
        for end, n in self.neutral.iter(f):
            covered[end - n + 1] = max(covered.get(end - n + 1, 0), end + 1)
        lead: dict[tuple[str, str, int], tuple[int, int]] = {}
        best: dict[tuple[str, str, int], int] = {}
        most = (lambda n: 0 if n < 3 else 1) if masked else (lambda n: 0 if n < 6 else 1)
        for start, end, (part, term, form), edits in self.trie.scan(f, most, starts, first_stands=not masked):
            if edits and "○" not in f[start:end] and not (bound(form) and f[start] == form[0]):
                continue
            key = (part, term, start // 2)
            if key not in best or edits < best[key]:
                best[key], lead[key] = edits, (start, end)
        out = [Hit(a, b, part, term, lex.PARTS[part][0]) for (part, term, _), (a, b) in lead.items()]
        if not out:
            return []
        for end, (n, parts, term) in self.company.iter(f):
            out += [Hit(end - n + 1, end + 1, p, term, lex.PARTS[p][0]) for p in parts]
        out += [Hit(m.start(), m.end(), "group", m.group()[0], lex.PARTS["group"][0]) for m in _GROUP.finditer(f)]
        return [self._weighed(s, h) for h in out if self._stands(s, h, covered)]

    @staticmethod
    def _stands(s: Folded, h: Hit, covered: dict[int, int]) -> bool:
        if covered and any(covered.get(a, 0) >= h.end for a in range(h.start, h.start - _LONGEST, -1)):
            return False
        if h.term.isascii():
            return s.whole_word(h.start, h.end)
        form = s.text[h.start : h.end]
        return len(form) > 3 or h.part not in lex.ALONE or not re.fullmatch("[ぁ-ゖー]+", form) or s.short_kana(h.start, h.end)

    @staticmethod
    def _weighed(s: Folded, h: Hit) -> Hit:
        f, w = s.text, h.weight
        if any(a <= h.start and h.end <= b for a, b in s.mentions) or _SPOKEN_OF.match(f[h.end : h.end + 8]) or _WORD_OF.search(f[max(0, h.start - 10) : h.start]):
            w *= QUOTED
        elif h.part == "insult" and any(f[max(0, h.start - len(x) - 2) : h.start].startswith(x) or f[max(0, h.start - len(x)) : h.start] == x for x in _SELF):
            w *= ONESELF
        return h._replace(weight=w)

    @staticmethod
    def scores(s: Folded, hits: list[Hit]) -> tuple[float, float, float]:
        """The best window of each class."""
        out = []
        for kind in CLASSES:
            own = sorted((h for h in hits if kind in lex.PARTS[h.part][1]), key=lambda h: (-h.weight, h.start - h.end, h.start))
            # each letter belongs to one term, the weightiest
            taken = bytearray(len(s.text))
            kept: list[Hit] = []
            for h in own:
                if not any(taken[h.start : h.end]):
                    taken[h.start : h.end] = b"\1" * (h.end - h.start)
                    kept.append(h)
            kept.sort()
            leading = [h for h in kept if h.part in lex.LEADING]
            at, lead_at = [h.start for h in kept], [h.start for h in leading]
            best = 0.0
            for one in leading:
                near = leading[bisect_left(lead_at, one.start - WINDOW) : bisect_right(lead_at, one.start + WINDOW)]
                parts: dict[str, dict[str, float]] = {}
                for h in near:
                    held = parts.setdefault(h.part, {})
                    held[h.term] = max(held.get(h.term, 0.0), h.weight)
                for h in kept[bisect_left(at, one.start - 2 * WINDOW) : bisect_right(at, one.start + 3 * WINDOW)]:
                    reach = lex.PARTS[h.part][3]
                    if reach and any(h.start - x.end <= reach and x.start - h.end <= reach for x in near):
                        held = parts.setdefault(h.part, {})
                        held[h.term] = max(held.get(h.term, 0.0), h.weight)
                if "named" in parts:
                    parts.pop("group", None)
                if all(h.part == "violence" for h in near):
                    parts = {p: held for p, held in parts.items() if p not in lex.TURNED}
                score = sum(sum(sorted(held.values(), reverse=True)[: lex.PARTS[p][2]]) for p, held in parts.items())
                if kind == "abuse" and one.part == "command" and one.start == 0 and one.end == len(s.text):
                    score += one.weight
                if kind == "hate" and not {"group", "named"} & set(parts) and not any(h.term in _INHERENT for h in near):
                    score = min(score, NO_GROUP)
                best = max(best, score)
            out.append(round(best, 2))
        return tuple(out)

    def document(self, text: str | None) -> tuple[float, float, float]:
        """The highest sentence score of each class."""
        abuse = hate = sexual = 0.0
        for s in sentences(text or ""):
            a, h, x = self.sentence(s)
            abuse, hate, sexual = max(abuse, a), max(hate, h), max(sexual, x)
        return abuse, hate, sexual


@lru_cache(maxsize=1)
def lexicon() -> Lexicon:
    """The worker's lexicon."""
    return Lexicon()


def scored(df: DataFrame, text: str) -> DataFrame:
    """`df` with abuse_score, hate_score, sexual_score and toxic (any of them from THRESHOLD on)."""

    @F.pandas_udf("abuse double, hate double, sexual double")
    def run(texts: pd.Series) -> pd.DataFrame:
        lex = lexicon()
        return pd.DataFrame([lex.document(t) for t in texts], columns=["abuse", "hate", "sexual"])

    d = spread(df).withColumn("_s", run(F.col(f"`{text}`")))
    d = d.withColumns({f"{c}_score": F.col(f"_s.{c}") for c in ("abuse", "hate", "sexual")}).drop("_s")
    return d.withColumn("toxic", F.greatest("abuse_score", "hate_score", "sexual_score") >= THRESHOLD)


def rates(df: DataFrame, source: str, text: str) -> DataFrame:
    """Per source: documents, cases and their rate in percent, cases of each class."""
    d = scored(df.select(F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text")), "text")
    return (
        d.groupBy("source")
        .agg(F.count("*").alias("docs"), F.count_if("toxic").alias("cases"), *[F.count_if(F.col(f"{c}_score") >= THRESHOLD).alias(f"n_{c}") for c in ("abuse", "hate", "sexual")])
        .withColumn("rate_pct", F.round(100.0 * F.col("cases") / F.col("docs"), 2))
    )
