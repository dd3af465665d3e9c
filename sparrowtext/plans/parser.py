"""The small query syntax: +must -must_not should, split at white space, terms as they are."""

from __future__ import annotations

import json
from collections.abc import Iterable

from .query import MUST, MUST_NOT, SHOULD, Bool, Query, Term


def parse(text: str, field: str = "text", msm: int = 0) -> Query:
    """One bare word is a term query; msm counts only if there are so many bare words."""
    words = text.split()
    if not words:
        raise ValueError("an empty query")
    if len(words) == 1 and words[0][0] not in "+-":
        return Term(field, words[0])
    occurs = {"+": MUST, "-": MUST_NOT}
    clauses = [(occurs[w[0]], Term(field, w[1:])) if w[0] in occurs else (SHOULD, Term(field, w)) for w in words]
    bare = sum(o == SHOULD for o, _ in clauses)
    return Bool(clauses, msm if 0 < msm <= bare else 0)


def read_batch(lines: Iterable[str], field: str = "text") -> list[Query]:
    """JSON lines {"q": text, "msm": least}; blank lines are skipped."""
    entries = (json.loads(x) for x in lines if x.strip())
    return [parse(e["q"], field, int(e.get("msm", 0))) for e in entries]
