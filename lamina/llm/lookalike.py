"""Visually identical text with different characters (problem 5).

Method: normalization quick-check properties isolate the unstable segments of
a text; only those, with the characters at their borders that normalization may
join them to, are normalized, and the canonical segments are spliced into the
text that stays as it is. A record of where each segment came from leads from
any place in the canonical text back to the one in the original.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.session import ship, table

# Letters of other scripts that look like a Latin letter (fixed values: a selection, listed in the README, of the confusable letters of the Unicode security data), as look-alike and Latin letter.
SAME = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјоргсухһӏԁԛԝүҽѵ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανοιυ" "ՕՍԼոսօցհյզ",
        "ABESIJKMHOPCTYXYGQWaesijoprcyxhldqwyev" "ABEZHIKMNOPTYXavoiu" "OULnuoghjq",
    )
)
_CONFUSABLE = str.maketrans(SAME)
#: Characters without a glyph.
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000E0000-\U000E0FFF]")
_SPACE = re.compile("[   -   　\u0085  ]")


def stable(c: str) -> bool:
    """Quick check: whether the character stands for itself whatever its neighbours: a starter that normalization, folding and splicing leave alone."""
    return c < "\u0080" or (
        unicodedata.is_normalized("NFKC", c) and not unicodedata.combining(c) and c not in SAME and not _INVISIBLE.match(c) and not _SPACE.match(c) and unicodedata.normalize("NFKD", c).translate(_CONFUSABLE) in (c, unicodedata.normalize("NFKD", c)) and c not in "‐‑"
    )


@lru_cache(maxsize=8192)
def _quick(c: str) -> bool:
    return stable(c)


def fold(segment: str) -> str:
    """The canonical form of a segment: invisible characters gone, compatibility forms resolved, look-alike letters Latin, accents composed, one kind of blank and hyphen."""
    s = unicodedata.normalize("NFKD", _SPACE.sub(" ", _INVISIBLE.sub("", segment)))
    s = _INVISIBLE.sub("", s).translate(_CONFUSABLE).replace("‐", "-").replace("‑", "-")
    return unicodedata.normalize("NFKC", s)


_NON_ASCII = re.compile("[^\x00-\x7F]+")


def segments(text: str) -> list[tuple[int, int, str]]:
    """(start, end, canonical) of each unstable segment that changes. A segment takes in the starter before it and the combining marks after it."""
    out: list[tuple[int, int, str]] = []
    end = 0
    for m in _NON_ASCII.finditer(text):
        i = m.start()
        while i < m.end():
            if _quick(text[i]):
                i += 1
                continue
            j = i + 1
            while j < len(text) and not _quick(text[j]):
                j += 1
            start = i - 1 if i > end and (unicodedata.combining(text[i]) or _INVISIBLE.match(text[i])) else i
            new = fold(text[start:j])
            if new != text[start:j]:
                out.append((start, j, new))
                end = j
            i = j
    return out


def splice(text: str, changed: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for start, end, new in changed:
        parts += [text[at:start], new]
        at = end
    return "".join(parts) + text[at:]


def canonical(text: str) -> str:
    """The one consistent form of a text. It is its own canonical form."""
    return text if text.isascii() else splice(text, segments(text))


class Places:
    """Where the entries stand in canonical texts, and the writing they have in the original."""

    def __init__(self, entries: list[tuple[int, str]]):
        import ahocorasick

        self.automaton, self.own = ahocorasick.Automaton(), {}
        by: dict[str, list[tuple[int, str]]] = {}
        for entry, value in entries:
            by.setdefault(canonical(value), []).append((entry, value))
        for form, same in by.items():
            if form:
                self.automaton.add_word(form, (form, same))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.whole = by

    def exact(self, text: str) -> list[int]:
        """Entries that the whole text shows in other characters."""
        return [e for e, value in self.whole.get(canonical(text), ()) if value != text]

    def within(self, text: str) -> set[int]:
        """Entries that some place of the text shows in other characters."""
        changed = segments(text)
        if not changed or not len(self.automaton):
            return set()
        form = splice(text, changed)
        # Borders of the segments in the canonical text, to find a place's origin.
        starts, shift, spans = [], 0, []
        for start, end, new in changed:
            spans.append((start + shift, start + shift + len(new), start, end))
            shift += len(new) - (end - start)
        found = set()
        for last, (value_form, same) in self.automaton.iter(form):
            a, b = last + 1 - len(value_form), last + 1
            if b < len(form) and unicodedata.combining(form[b]):
                continue  # the last letter has another accent
            touched = [s for s in spans if s[0] < b and s[1] > a]
            for e, value in same:
                if e in found:
                    continue
                if value != value_form or touched:
                    lo, hi = _origin(spans, a, False), _origin(spans, b, True)
                    if text[lo:hi] != value and not (touched and _own(text, touched, value, lo, hi)):
                        found.add(e)
        return found


def _origin(spans, at: int, closing: bool) -> int:
    """The original offset of a canonical one; inside a segment, the segment's border outwards."""
    shift = 0
    for c0, c1, o0, o1 in spans:
        if at <= c0 if closing else at < c0:
            break
        if c0 < at < c1 or (at == c0 and not closing and c1 > c0):
            return o1 if closing else o0
        shift = o1 - c1
    return at + shift


def _own(text: str, touched, value: str, lo: int, hi: int) -> bool:
    """Whether the entry's own writing stands there and only neighbours of it were changed."""
    return value in text[lo:hi] and len(text[lo:hi]) - len(value) <= sum(o1 - o0 for _, _, o0, o1 in touched)


def find(df: DataFrame, key: str, text: str, entries: list[tuple[int, str]], whole: bool) -> DataFrame:
    """(record_id, entry_id) for each record whose text is (whole) or holds (else) an entry's value in other characters that look the same.

    ASCII texts and nulls are dropped before any Python is reached: plain
    ASCII stands only for itself. Entries with a null or empty value match
    nothing. Case and accents count. Rows twice give one row; a null key is
    left out; an empty table gives no rows. Texts are read whole.
    """
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast([(e, v) for e, v in entries if e is not None and v])
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & F.col("t").rlike(r"[^\x00-\x7F]"))

    def run(batches):
        places = Places(shared.value)
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out += [(k, e) for e in (places.exact(t) if whole else places.within(t))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["record_id", "entry_id"])

    return rows.mapInArrow(run, "record_id long, entry_id long").distinct()


def normalized(df: DataFrame, text: str, into: str) -> DataFrame:
    """The table with one more column, the canonical form of a text column; null for null."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(canonical, na_action="ignore")

    return df.withColumn(into, F.when(F.col(text).rlike(r"[^\x00-\x7F]"), run(text)).otherwise(F.col(text)))


def watchlist(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """The watchlist: a fixed table of hundreds of entries, read with a limit it must not reach."""
    rows = table(spark, folder, "watchlist").select("entry_id", "value").limit(1_000_001).collect()
    if len(rows) > 1_000_000:
        raise ValueError("more than a million watchlist entries")
    return [tuple(r) for r in rows]


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    entries = watchlist(spark, folder)
    a = find(table(spark, folder, "findings"), "id", "value", entries, whole=True).select(F.lit("finding").alias("record_kind"), "record_id", "entry_id")
    b = find(table(spark, folder, "analyses"), "id", "original_text", entries, whole=False).select(F.lit("analysis").alias("record_kind"), "record_id", "entry_id")
    return a.unionByName(b)


def p5_findings(spark: SparkSession, folder: str) -> DataFrame:
    """All findings with their value in its canonical form."""
    return normalized(table(spark, folder, "findings").select("id", "type", "value"), "value", "canonical_value")


QUERIES = {"p5_found": p5_found, "p5_findings": p5_findings}
SQL: dict[str, str] = {}
