"""Analyzers: text column -> array of terms, in codegen-friendly built-in functions.

`standard`: letters, digits and underscore make a token, an apostrophe stays between them; ASCII is
lower-cased; of a longer token the first 255 characters count. `unicode`: full lower-casing and word
boundaries after UAX #29. `keyword`: the value itself. Null text has no tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_TOKEN = 255
#: Common characters come first and quantifiers are possessive: what may follow a run is never part of it.
_WORD = r"[a-z0-9_\p{IsAlphabetic}\p{N}]"
STANDARD = rf"{_WORD}++(?:['’][a-z0-9\p{{IsAlphabetic}}\p{{N}}]{_WORD}*+)*+"
_CJK = r"\p{IsIdeographic}\p{IsHiragana}\p{IsKatakana}"
_LETTER = rf"[\p{{IsAlphabetic}}\p{{M}}&&[^{_CJK}]]"
_RUN = rf"(?:[\p{{IsAlphabetic}}\p{{M}}\p{{Nd}}_&&[^{_CJK}]]++|[\p{{IsKatakana}}ー]++)"
UNICODE = rf"{_RUN}(?:(?:(?<={_LETTER})[:·.'’‘](?={_LETTER})|(?<=\p{{Nd}})[,;.'’‘](?=\p{{Nd}})){_RUN})*+|[\p{{IsIdeographic}}\p{{IsHiragana}}]"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; a text of ASCII alone takes the faster lower()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def standard(text: Column) -> Column:
    return F.transform(_all(ascii_lower(text), STANDARD), lambda t: F.substring(t, 1, MAX_TOKEN))


def unicode(text: Column) -> Column:
    return F.filter(_all(F.lower(text), UNICODE), lambda t: t.rlike(r"[\p{IsAlphabetic}\p{N}]"))


def keyword(value: Column) -> Column:
    return F.when(value.isNull(), F.expr("CAST(array() AS array<string>)")).otherwise(F.array(value.cast("string")))


ANALYZERS: dict[str, Callable[[Column], Column]] = {"standard": standard, "unicode": unicode, "keyword": keyword}


def register(name: str, analyzer: Callable[[Column], Column]) -> None:
    """Add an analyzer: any function from a text column to an array<string> column."""
    ANALYZERS[name] = analyzer


def without(analyzer: Callable[[Column], Column], words: list[str]) -> Callable[[Column], Column]:
    """An analyzer that leaves stop words out; what follows moves up."""
    return lambda text: F.filter(analyzer(text), lambda t: ~t.isin(*words)) if words else analyzer(text)


def with_synonyms(analyzer: Callable[[Column], Column], synonyms: dict[str, str]) -> Callable[[Column], Column]:
    """An analyzer that writes every synonym as the one word that stands for it."""
    table = F.create_map(*[F.lit(x) for pair in sorted(synonyms.items()) for x in pair])
    return lambda text: F.transform(analyzer(text), lambda t: F.coalesce(F.try_element_at(table, t), t))


def singular(token: Column) -> Column:
    """English plurals as singulars: -ies (not -eies, -aies) to -y, -es (not -aes, -ees, -oes) to -e, -s (not -us, -ss) off."""
    return (
        F.when(token.rlike("[^ea]ies$"), F.regexp_replace(token, "ies$", "y"))
        .when(token.rlike("ies$"), token)
        .when(token.rlike("[^aeo]es$"), F.regexp_replace(token, "s$", ""))
        .when(token.rlike("es$"), token)
        .when(token.rlike("[^us]s$"), F.regexp_replace(token, "s$", ""))
        .otherwise(token)
    )


def stemmed(analyzer: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda text: F.transform(analyzer(text), singular)


def pieces(text: Column, analyzer: str = "standard") -> tuple[Column, Column]:
    """(raw tokens, gaps around them) for byte offsets; standard and unicode only. The unicode
    analyzer's offsets refer to the lower-cased text."""
    pattern = {"standard": STANDARD, "unicode": UNICODE}[analyzer]
    folded = F.lower(text) if analyzer == "unicode" else ascii_lower(text)
    folded = F.coalesce(folded, F.lit(""))
    return _all(folded, pattern), F.split(folded, pattern, -1)


#: Tokens that term_groups sorts at once.
SORTED_AT_ONCE = 1 << 20
_PLACES = pa.list_(pa.int32())


def _grouped(words: pa.Array, ends: np.ndarray, steps: np.ndarray | None, raw: np.ndarray | None, places: bool) -> pa.ListArray:
    """term_groups of the texts whose tokens end at `ends`, in flat arrays. Each token is one number, (text, term, place), so that sorting numbers sorts tokens."""
    begins, counts = np.concatenate(([0], ends[:-1])), np.diff(ends, prepend=0)
    coded = words.dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary).to_numpy()  # in the order of their bytes
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    longest, kinds = int(counts.max(initial=1)) or 1, len(order) or 1
    text = np.repeat(np.arange(len(ends)), counts)
    key = (text * kinds + rank[coded.indices.to_numpy()]) * longest + np.arange(len(words)) - begins[text]
    key.sort()
    group, pos = np.divmod(key, longest)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    bounds = pa.array(np.append(first, len(key)), pa.int32())
    lists = lambda v: pa.ListArray.from_arrays(bounds, pa.array(v, pa.int32()))
    held = [lists(pos)] if places else []
    if steps is not None:
        at = begins[group // kinds] + pos
        total = np.cumsum(steps)
        before = (total - steps)[np.minimum(begins, max(len(steps) - 1, 0))] if len(steps) else begins
        held += [lists((total - raw - before[text])[at]), lists(pc.binary_length(words).to_numpy(zero_copy_only=False)[at])]
    held += [pa.nulls(len(first), _PLACES)] * (3 - len(held))
    of, term = np.divmod(group[first], kinds)
    columns = [coded.dictionary.take(pa.array(order[term])), pa.array(np.diff(first, append=len(key)), pa.int32()), *held, pa.array(pos[first] == 0)]
    groups = pa.StructArray.from_arrays(columns, ["term", "tf", "positions", "starts", "lens", "head"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=len(ends)))), pa.int32()), groups)


def term_groups(terms: Column, places: bool, steps: Column | None = None, raw: Column | None = None) -> Column:
    """array<string> tokens of a text -> its terms in byte order, each with its frequency, places and whether the text begins with it;
    given the bytes from each token's end to the next one's (steps) and of each token (raw), with byte starts and lengths too."""

    def flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
        ends = lists.offsets.to_numpy().astype(np.int64)
        return lists.values[ends[0] : ends[-1]], ends[1:] - ends[0]

    def groups(terms: pa.Array, *sizes: pa.Array) -> pa.Array:
        words, ends = flat(terms)
        sizes = [flat(x)[0].to_numpy(zero_copy_only=False).astype(np.int64) for x in sizes] or [None, None]
        out, row, done = [], 0, 0
        while row < len(ends) or not out:  # whole texts, as many as are sorted at once, one at least
            to = max(int(np.searchsorted(ends, done + SORTED_AT_ONCE, "right")), min(row + 1, len(ends)))
            end = int(ends[to - 1]) if to else 0
            out.append(_grouped(words[done:end], ends[row:to] - done, *[x if x is None else x[done:end] for x in sizes], places))
            row, done = to, end
        return pa.concat_arrays(out)

    kind = "array<struct<term:string,tf:int,positions:array<int>,starts:array<int>,lens:array<int>,head:boolean>>"
    if steps is None:
        return F.arrow_udf(lambda t: groups(t), kind)(terms)
    return F.arrow_udf(lambda t, s, r: groups(t, s, r), kind)(terms, steps, raw)
