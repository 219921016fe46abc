"""Results as text: tab-separated for other programs, boxed for people."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

#: Rows of a page of boxed output.
PAGE = 1000


def value(x: object) -> str:
    """NULL, whole numbers in full, other numbers with six significant digits, texts as they are."""
    if x is None:
        return "NULL"
    return format(x, ".6g") if isinstance(x, float) else str(x)


def tsv(names: list[str], rows: Iterable[Iterable[object]]) -> Iterator[str]:
    """A line of names, then one for each row as it comes."""
    yield "\t".join(names)
    for row in rows:
        yield "\t".join(map(value, row))


def boxed(names: list[str], rows: Iterable[Iterable[object]], page: int = PAGE) -> Iterator[str]:
    """Tables in frames of at most `page` rows each as they come, each column as wide as its widest cell on the page, so what is
    held does not grow with the result; `Empty set.` without rows."""
    rows, none = iter(rows), True
    while cells := [[value(x) for x in row] for row in islice(rows, page)]:
        none = False
        widths = [max(len(r[i]) for r in [names, *cells]) for i in range(len(names))]
        rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
        line = lambda r, widths=widths: "| " + " | ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)) + " |"
        yield from (rule, line(names), rule, *map(line, cells), rule)
    if none:
        yield "Empty set."
