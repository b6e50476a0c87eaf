"""Title layout and pixel arithmetic as column expressions.

Glyph widths are a map from characters to widths at size 1, so that layout needs no font at run time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _once(value: Column, use: Callable) -> Column:
    """use(value) with value computed once: an expression that is used twice is written out and computed twice."""
    return F.transform(F.array(value), use)[0]


def _glyphs(text: Column, widths: Column, other: float) -> Column:
    """Width at size 1 of each character of a text; characters without an entry take `other`."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(widths, c), F.lit(other)))


def _sum(start: Column, glyphs: Column) -> Column:
    return F.aggregate(glyphs, start, lambda a, w: a + w)


def text_width(text: Column, widths: Column, size: Column, other: float = 0.6) -> Column:
    """Width of a text at a size; characters without an entry take `other`."""
    return size * _sum(F.lit(0.0), _glyphs(text, widths, other))


def _words(text: Column, widths: Column, other: float = 0.6) -> Column:
    """Words of a text with the widths of their characters."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.struct(w.alias("text"), _glyphs(w, widths, other).alias("glyphs")))


def _broken(words: Column, space: Column, size: Column, most: Column) -> Column:
    """struct(lines, wide): the lines of words at a size, and whether one of them is wider than `most`.

    The width of a line is carried along at size 1 and grows by the characters of each word, in the order in which the
    whole line would be summed, so it is the same number, and a text costs its characters once a size.
    """
    def add(acc: Column, word: Column) -> Column:
        def place(at: Column) -> Column:
            fits = (acc["cur"] == "") | (size * at["longer"] <= most)
            cur = F.when(acc["cur"] == "", word["text"]).when(fits, F.concat(acc["cur"], F.lit(" "), word["text"])).otherwise(word["text"])
            width = F.when(fits, at["longer"]).otherwise(_sum(F.lit(0.0), word["glyphs"]))
            lines = F.when(fits, acc["lines"]).otherwise(F.concat(acc["lines"], F.array(acc["cur"])))
            wide = F.when(fits, acc["wide"]).otherwise(acc["wide"] | (size * acc["width"] > most))
            return _once(F.struct(cur.alias("cur"), width.alias("width"), lines.alias("lines"), wide.alias("wide")), close)

        longer = _sum(F.when(acc["cur"] == "", F.lit(0.0)).otherwise(acc["width"] + space), word["glyphs"])
        return _once(F.struct(longer.alias("longer")), place)

    def close(new: Column) -> Column:
        """A break after the comma that ends a part of the first line."""
        ends = (F.size(new["lines"]) == 0) & new["cur"].endswith(",")
        return F.when(ends, F.struct(F.lit("").alias("cur"), F.lit(0.0).alias("width"), F.array(new["cur"]).alias("lines"), (new["wide"] | (size * new["width"] > most)).alias("wide"))).otherwise(new)

    def end(acc: Column) -> Column:
        open_ = acc["cur"] != ""
        lines = F.when(open_, F.concat(acc["lines"], F.array(acc["cur"]))).otherwise(acc["lines"])
        return F.struct(lines.alias("lines"), (acc["wide"] | (open_ & (size * acc["width"] > most))).alias("wide"))

    start = F.struct(F.lit("").alias("cur"), F.lit(0.0).alias("width"), F.array().cast("array<string>").alias("lines"), F.lit(False).alias("wide"))
    return F.aggregate(words, start, add, end)


def _space(widths: Column, other: float = 0.6) -> Column:
    return F.coalesce(F.try_element_at(widths, F.lit(" ")), F.lit(other))


def wrapped(text: Column, widths: Column, size: Column, most: Column) -> Column:
    """Lines of a text: as many words as fit, and a break after the comma that ends a part of the first line."""
    return _once(_words(text, widths), lambda words: _broken(words, _space(widths), size, most)["lines"])


def fitted(text: Column, widths: Column, box_w: Column, box_h: Column, start: int, floor: int = 20, step: int = 2) -> Column:
    """struct(size, lines, line_height) of the largest size, from `start` down by `step`, whose lines fit the box;
    the floor size, its lines and 24 where none does. Sizes below the first that fits are not laid out."""
    def layout(words: Column) -> Column:
        def at(size: int) -> Column:
            def judged(found: Column) -> Column:
                height = F.floor(F.lit(size) * 1.18).cast("int")
                return F.when((F.size(found["lines"]) * height <= box_h) & ~found["wide"], F.struct(F.lit(size).alias("size"), found["lines"].alias("lines"), height.alias("line_height")))

            return _once(_broken(words, _space(widths), F.lit(size), box_w), judged)

        least = F.struct(F.lit(floor).alias("size"), _broken(words, _space(widths), F.lit(floor), box_w)["lines"].alias("lines"), F.lit(24).alias("line_height"))
        return F.coalesce(*[at(size) for size in range(start, floor - 1, -step)], least)

    return _once(_words(text, widths), layout)


def resized(rows: Column, size: int) -> Column:
    """A grey crop (array of rows) as a square of `size`, linear between the centres of its cells, halves up."""
    once = lambda value, use: F.transform(F.array(value), use)[0]

    def axis(n: Column) -> Column:
        def place(i: Column) -> Column:
            at = (i + 0.5) * n / size - 0.5
            low = F.floor(at).cast("int")
            inner = (low >= 0) & (low < n - 1)
            low_ = F.greatest(F.lit(0), F.least(low, n - 1))
            return F.struct(low_.alias("a"), F.when(inner, low_ + 1).otherwise(low_).alias("b"), F.when(inner, at - low).otherwise(0.0).alias("f"))

        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), place)

    def lines_(ys: Column, xs: Column) -> Column:
        cell = lambda y, x: F.get(F.get(rows, y), x).cast("double")
        line = lambda y, x: cell(y, x["a"]) * (1 - x["f"]) + cell(y, x["b"]) * x["f"]
        return F.transform(ys, lambda y: F.transform(xs, lambda x: F.round(line(y["a"], x) * (1 - y["f"]) + line(y["b"], x) * y["f"])))

    return once(F.struct(axis(F.size(rows)).alias("y"), axis(F.size(rows[0])).alias("x")), lambda p: lines_(p["y"], p["x"]))


def sharpness(rows: Column, size: int | None = None) -> Column:
    """Variance of the Laplacian of a grey crop (array of rows), edges mirrored, of the crop as a square of
    `size` if that is given; 0.0 for fewer than 8 rows or columns."""
    small = rows.isNull() | (F.size(rows) < 8) | (F.size(rows[0]) < 8)
    mirror = lambda i, n: F.when(i < 0, -i).when(i >= n, 2 * n - 2 - i).otherwise(i)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, v: a + v)

    def spread(grid: Column) -> Column:
        h, w = F.size(grid), F.size(grid[0])
        at = lambda y, x: F.get(F.get(grid, mirror(y, h)), mirror(x, w)).cast("double")
        second = F.flatten(F.transform(F.sequence(F.lit(0), h - 1), lambda y: F.transform(F.sequence(F.lit(0), w - 1), lambda x: at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x))))
        return F.transform(F.array(second), lambda v: total(F.transform(v, lambda x: x * x)) / F.size(v) - F.pow(total(v) / F.size(v), F.lit(2.0)))[0]

    grid = rows if size is None else resized(rows, size)
    return F.when(small, F.lit(0.0)).otherwise(F.transform(F.array(grid), spread)[0])


def on_white(value: Column, alpha: Column) -> Column:
    """A channel value over white by its alpha (0 to 255), halves to even."""
    a = alpha / 255.0
    return F.bround(value * a + 255.0 * (1 - a), 0).cast("int")


def target_size(h: Column, w: Column, width: Column, scale: Column, native: int = 4) -> Column:
    """struct(h, w) that an enlarged image is brought to: by width, else by scale; null where nothing changes."""
    by_width = F.struct(F.bround(h * width / w, 0).cast("int").alias("h"), width.cast("int").alias("w"))
    by_scale = F.struct(F.bround(h * scale, 0).cast("int").alias("h"), F.bround(w * scale, 0).cast("int").alias("w"))
    wanted = F.when(width > 0, by_width).when(scale != native, by_scale)
    return F.when(wanted.isNotNull() & ~((wanted["h"] == h * native) & (wanted["w"] == w * native)), wanted)
