"""HTML tables: grid with spans, header detection and text forms."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from leafspan.functions import text as T


class _Cells(HTMLParser):
    """Collect rows of ``(column span, row span, text)``."""

    def __init__(self) -> None:
        super().__init__()
        self.rows, self.inside = [], False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            spans = {k: int(v) for k, v in attrs if k in ("colspan", "rowspan") and v and v.isdigit()}
            self.rows[-1].append([spans.get("colspan", 1), spans.get("rowspan", 1), ""])
            self.inside = True

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.inside = False

    def handle_data(self, data):
        if self.inside and self.rows and self.rows[-1]:
            self.rows[-1][-1][2] += data.strip()


def _grid(html: str | None) -> list[list[str | None]]:
    parser = _Cells()
    parser.feed(html or "")
    taken: dict[tuple[int, int], str] = {}
    for r, row in enumerate(parser.rows):
        for width, height, text in row:
            c = next(i for i in range(len(taken) + 1) if (r, i) not in taken)
            for at in ((r + i, c + j) for i in range(height) for j in range(width)):
                taken.setdefault(at, text)
    rows = max([len(parser.rows), *[r + 1 for r, _ in taken]]) if parser.rows else 0
    widths = [max([c + 1 for rr, c in taken if rr == r], default=0) for r in range(rows)]
    return [[taken.get((r, c)) for c in range(widths[r])] for r in range(rows)]


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def grid(html: pd.Series) -> pd.Series:
    """Rows of cell texts; spanned cells repeat their text, rows may differ in length."""
    return html.map(_grid)


def column_count(html: Column) -> Column:
    """Largest sum of column spans over the rows of a table."""
    rows = F.split(html, "(?i)<tr[^>]*>")
    cells = lambda row: F.regexp_extract_all(row, F.lit(r"(?i)<t[dh]([^>]*)>"), F.lit(1))
    span = lambda attrs: F.coalesce(
        F.regexp_extract(attrs, r"(?i)colspan\s*=\s*[\"']?(\d+)", 1).try_cast("int"), F.lit(1)
    )
    widths = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda row: F.aggregate(
        cells(row), F.lit(0), lambda total, attrs: total + span(attrs)
    ))
    return F.coalesce(F.array_max(widths), F.lit(0))


def append_rows(first: Column, second: Column) -> Column:
    """Rows of the second table added to the first; without a table element the two texts are concatenated."""
    rows = F.array_join(F.regexp_extract_all(second, F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0)), "")
    close = F.when(F.contains(first, F.lit("</tbody>")), "</tbody>").otherwise("</table>")
    at = F.length(first) - F.instr(F.reverse(first), F.reverse(close)) - F.length(close) + 2
    joined = F.concat(F.substring(first, F.lit(1), at - 1), rows, F.substring(first, at, F.length(first)))
    return F.when(F.contains(first, F.lit("<table")), joined).otherwise(F.concat(first, second))


def is_numeric_cell(cell: Column) -> Column:
    """Number after dropping percent signs, brackets and thousands separators."""
    return F.coalesce(T.parse_number(F.translate(T.strip(cell), "%(),", "")).isNotNull(), F.lit(False))


def has_letters(cell: Column) -> Column:
    return F.coalesce(cell.rlike("[a-zA-Z]"), F.lit(False))


def header_rows(cells: Column) -> Column:
    """Number of leading header rows among the first three.

    A row is a header when neighbouring cells repeat, when more than a third of the columns turn from text to
    number below it, or when more than half change their kind. A first row of text over another row of text is a
    header when more than half of the cells differ.
    """
    widest = F.array_max(F.transform(cells, F.size))

    def signals(i: int) -> tuple[Column, Column]:
        row, below = F.get(cells, F.lit(i)), F.get(cells, F.lit(i + 1))
        width = F.least(F.size(row), F.size(below))
        pairs = F.zip_with(
            F.slice(row, 1, width), F.slice(below, 1, width),
            lambda a, b: F.struct(
                is_numeric_cell(a).alias("a"), is_numeric_cell(b).alias("b"), (~a.eqNullSafe(b)).alias("differs")
            ),
        )
        count = lambda test: F.size(F.filter(pairs, test))
        repeats = F.exists(
            F.zip_with(row, F.slice(row, 2, F.greatest(F.size(row), F.lit(1))), lambda a, b: F.coalesce((a == b) & (a != ""), F.lit(False))),
            lambda x: x,
        )
        strong = (
            (count(lambda p: ~p["a"] & p["b"]) > widest / 3) | repeats | (count(lambda p: p["a"] != p["b"]) > widest / 2)
        )
        plain = lambda cells_: ~F.exists(cells_, is_numeric_cell)
        fallback = plain(row) & plain(below) & (count(lambda p: p["differs"]) > widest / 2)
        return strong, fallback

    depth = F.least(F.lit(3), F.size(cells) - 1)
    strong0, fallback0 = signals(0)
    first, second, third = strong0 | fallback0, signals(1)[0], signals(2)[0]
    return (
        F.when(F.size(cells) == 0, 0).when(F.size(cells) == 1, 1).when(~first, 0)
        .when((depth < 2) | ~second, 1).when((depth < 3) | ~third, 2).otherwise(3)
    )


def headers(cells: Column, n_rows: Column) -> Column:
    """Sorted distinct header paths, levels joined by `` > ``."""
    first = F.get(cells, F.lit(0))
    path = lambda n, j: F.array_join(
        F.array_distinct(F.filter(F.transform(F.slice(cells, 1, n), lambda row: T.strip(F.get(row, j))), lambda x: x != "")),
        " > ",
    )
    columns = F.when(F.size(first) > 0, F.sequence(F.lit(0), F.size(first) - 1)).otherwise(F.array().cast("array<int>"))
    found = lambda n: F.array_sort(F.array_distinct(F.array_remove(F.transform(columns, lambda j: path(n, j)), "")))
    listed = lambda n: F.when((n > 0) & (F.size(cells) >= n), found(n)).otherwise(F.array().cast("array<string>"))
    # Bound by an array of one, the number of rows is worked out once and not again for every column.
    return F.get(F.transform(F.array(n_rows), listed), F.lit(0))


def table_text(caption: Column, cells: Column, footnote: Column) -> Column:
    """Caption, column list, rows of `` | `` cells and footnote, one part per line."""
    listed = F.array_join(F.transform(headers(cells, header_rows(cells)), lambda h: F.concat(F.lit(" - "), h, F.lit("\n"))), "")
    rows = F.array_join(
        F.transform(cells, lambda row: F.array_join(F.transform(row, lambda c: F.coalesce(T.strip(c), F.lit(""))), " | ")), "\n"
    )
    parts = F.array(
        F.when(caption != "", F.concat(F.lit("Caption: "), caption)),
        F.when(F.size(cells) > 0, F.concat(F.lit("This table contains the following columns:\n"), listed)),
        F.when(F.size(cells) > 0, F.concat(F.lit("Table Body:\n"), rows)),
        F.when(footnote != "", F.concat(F.lit("Footnote: "), footnote)),
    )
    return F.array_join(parts, "\n")


def linearised(caption: Column, cells: Column, footnote: Column, threshold: float = 0.5) -> Column:
    """Label summary of a data-heavy table, or full sentences of a text-heavy one."""
    flat = F.filter(F.flatten(cells), lambda c: c.isNotNull() & (c != ""))
    heavy = F.size(F.filter(flat, lambda c: ~has_letters(c))) / F.size(flat) >= threshold
    labels = lambda a: F.array_sort(F.array_distinct(F.filter(a, has_letters)))
    columns = labels(F.flatten(F.slice(cells, 1, 2)))
    rows = labels(F.flatten(F.transform(cells, lambda row: F.slice(row, 1, 2))))
    others = F.array_except(F.array_except(labels(flat), columns), rows)
    listed = lambda name, a: F.when(F.size(a) > 0, F.concat(F.lit(f"{name}: "), F.array_join(a, ", ")))
    head = F.get(cells, F.lit(0))
    sentence = lambda row, i: T.strip(F.concat(
        F.lit("Row "), (i + 1).cast("string"), F.lit(": "),
        F.array_join(F.filter(F.zip_with(head, row, lambda h, c: F.when(
            (h != "") & (c != ""), F.concat(F.lit("'"), h, F.lit("' is '"), c, F.lit("'; ")))), lambda x: x.isNotNull()), ""),
    ))
    body = F.when(heavy, F.array_join(F.array(
        F.lit("Type: Data-heavy table (schema summary)"), listed("Column Labels", columns), listed("Row Labels", rows),
        listed("Other Labels", others)), "\n",
    )).otherwise(F.array_join(F.concat(
        F.array(F.lit("Type: Text-heavy table (full linearization)")),
        F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), sentence)), "\n",
    ))
    full = F.array_join(F.array(
        F.when(caption != "", F.concat(F.lit("Table Caption: "), caption)), body,
        F.when(footnote != "", F.concat(F.lit("Footnote: "), footnote))), "\n",
    )
    return F.when(F.size(flat) > 0, full).otherwise(F.coalesce(caption, F.lit("")))
