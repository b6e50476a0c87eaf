"""Frame scores, group scores, anchors, selection of stills and of tiles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frame_scores(faces: DataFrame, keys: list[str], score: str, role: str, main: Column) -> DataFrame:
    """keys, score, roles, n_faces: the best face's score, raised by the number of main roles beyond the first."""
    n_main = F.count_distinct(F.when(main, F.col(role)))
    return faces.groupBy(*keys).agg((F.max(score) * (1 + F.greatest(F.lit(0), n_main - 1))).alias("score"), F.array_sort(F.collect_set(role)).alias("roles"), F.count(F.lit(1)).alias("n_faces"))


def weakest_role(faces: DataFrame, keys: list[str], role: str, quality: str, wanted: int) -> DataFrame:
    """keys, group_score: the least of the roles' best qualities; 0 unless all `wanted` roles are there."""
    best = faces.groupBy(*keys, role).agg(F.max(quality).alias("q"))
    return best.groupBy(*keys).agg(F.when((F.count(F.lit(1)) == wanted) & (F.lit(wanted) > 0), F.min("q")).otherwise(F.lit(0.0)).alias("group_score"))


def anchors(faces: DataFrame, key: str, width: str, pos: str, payload: str) -> DataFrame:
    """key, payload of the widest face, the first of equals."""
    return faces.groupBy(key).agg(F.max_by(payload, F.struct(F.col(width), (-F.col(pos)).alias("p"))).alias(payload), F.max(width).alias(width))


def solo_score(quality: Column, alone: Column, similarity: Column) -> Column:
    """Solo quality, more for a frame of one face, weighted by nearness to the anchor where there is one."""
    return quality * F.when(alone, 1.35).otherwise(1.0) * F.when(similarity.isNotNull(), 0.4 + F.greatest(F.lit(0.0), similarity)).otherwise(1.0)


def padded(n: Column, tile: Column, overlap: int = 32) -> Column:
    """Size of an axis that tiles of `tile` with an overlap cover: ceilings by integer arithmetic."""
    step = tile - overlap
    steps = ((F.greatest(F.lit(0), n - tile) + step - 1) / step).cast("int")
    return F.greatest(tile, steps * step + tile)


def tile_count(n: Column, tile: Column, overlap: int = 32) -> Column:
    return ((padded(n, tile, overlap) - tile) / (tile - overlap)).cast("int") + 1


def tile_choice(images: DataFrame, key: str, h: str, w: str, sizes: tuple[int, ...] = (128, 192, 256, 384)) -> DataFrame:
    """key, tile, tiles, pixels: the tile size with the fewest computed pixels, the smallest of equals."""
    def cost(c: int) -> Column:
        n = (tile_count(F.col(h), F.lit(c)) * tile_count(F.col(w), F.lit(c))).cast("bigint")
        return F.struct((n * c * c).alias("pixels"), F.lit(c).alias("tile"), n.alias("tiles"))

    return images.select(key, F.array_min(F.array(*[cost(c) for c in sizes])).alias("m")).select(key, "m.tile", "m.tiles", "m.pixels")


def tile_coords(images: DataFrame, key: str, h: str, w: str, tile: Column, overlap: int = 32) -> DataFrame:
    """key, y, x of every tile."""
    axis = lambda n: F.explode(F.sequence(F.lit(0), padded(F.col(n), tile, overlap) - tile, tile - overlap))
    return images.withColumn("y", axis(h)).withColumn("x", axis(w)).select(key, "y", "x")


def ramp(i: Column, tile: Column, border: int = 32) -> Column:
    """Weight of place i of a tile: linear towards both ends."""
    return F.least(F.lit(1.0), (i + 1) / F.lit(border + 1.0), (tile - i) / F.lit(border + 1.0))


def axis_weights(images: DataFrame, key: str, n: str, tile: Column, overlap: int = 32) -> DataFrame:
    """key, at, weight: the summed weights of all tiles over each place of an axis. The sum over a plane is
    the product of its two axes' sums, so no plane is ever built."""
    starts = images.select(key, tile.alias("_t"), F.explode(F.sequence(F.lit(0), padded(F.col(n), tile, overlap) - tile, tile - overlap)).alias("_s"))
    cells = starts.select(key, "_t", "_s", F.explode(F.sequence(F.lit(0), F.col("_t") - 1)).alias("_i"))
    return cells.groupBy(key, (F.col("_s") + F.col("_i")).alias("at")).agg(F.sum(ramp(F.col("_i"), F.col("_t"), overlap)).alias("weight"))


def blended(cells: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """keys, value: the weighted mean of overlapping cells, clipped to a byte, halves to even."""
    return cells.groupBy(*keys).agg(F.bround(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.sum(F.col(value) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1e-6)))), 0).cast("int").alias(value))


def merged_tiles(tiles: DataFrame, key: str, tile: int, overlap: int = 32, cells: Callable | None = None, lines: tuple[str, Callable] | None = None) -> DataFrame:
    """key, y, values (bytes as an array) of every row of the images that tiles (key, h, w, y, x, values) make up.

    values of a tile: its tile * tile cells by rows. Where tiles overlap their cells are averaged by weights that rise
    linearly from a tile's edges, clipped to a byte, halves to even. A tile is cut into the rows that no tile
    below shares and those that one does; pieces meet by strips of tile - overlap rows, so a task holds a strip
    of an image, never a row for a cell and never an image. Weights are whole numbers (the scale cancels), so sums
    are exact for whole values. Null values of a tile count as 0; a tile given twice counts twice; an image of which
    no tile covers a cell has 0 there.

    cells(key, y, x, first, rows, columns), a matrix of a tile's first columns in `rows` rows from `first` on, takes the place
    of values: cells are then made where their strip is merged, and only the tiles' places are shuffled. lines (schema,
    function of a strip's matrix to columns) takes the place of the array, so that only what is asked of a row leaves the task.
    """
    step = tile - overlap
    ramp = np.minimum(overlap + 1, np.minimum(np.arange(1, tile + 1), np.arange(tile, 0, -1))).astype(float)
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    result, of_lines = lines or ("values array<int>", _as_arrays)
    names_of = [key, "y", *(x.split()[0] for x in result.split(", "))]

    def piece(at: int, rows: int, first: int) -> Column:
        strip = (F.floor(F.col("y") / step) + at).cast("int")
        own = [] if cells else [F.slice("values", first * tile + 1, rows * tile).alias("cells")]
        return F.struct(strip.alias("strip"), F.lit(first).alias("first"), F.lit(rows).alias("rows"), *own)

    cut = tiles.select(key, "h", "w", "y", "x", F.explode(F.array(piece(0, step, 0), piece(1, overlap, step))).alias("p")).select(F.col(key).cast("long").alias(key), "h", "w", "y", "x", "p.*")

    def merge(names: tuple, rows: pa.Table) -> pa.Table:
        k, strip = names[0].as_py(), names[1].as_py()
        h, w = rows["h"][0].as_py(), rows["w"][0].as_py()
        high = min(step, h - strip * step)
        total, weight = (np.zeros((high, w)) for _ in range(2))
        for i, (y, x, first, n) in enumerate(zip(*(rows[c].to_pylist() for c in ("y", "x", "first", "rows")), strict=True)):
            n, wide = min(n, high), min(tile, w - x)
            if wide <= 0:
                continue
            if cells:
                own = cells(k, y, x, first, n, wide)
            else:
                own = np.nan_to_num(rows["cells"][i].values.to_numpy(zero_copy_only=False).astype(float)).reshape(-1, tile)[:n, :wide]
            mine = ramp[first : first + len(own), None] * ramp[None, :wide]
            total[: len(own), x : x + wide] += own * mine
            weight[: len(own), x : x + wide] += mine
        merged = np.rint(np.clip(total / np.maximum(weight, 1e-6), 0, 255)).astype(np.int32)
        columns = [pa.array(np.full(high, k), pa.int64()), pa.array(strip * step + np.arange(high), pa.int64()), *map(pa.array, of_lines(merged))]
        return pa.table(columns, names=names_of)

    # dealt to a fixed number of tasks: the rows of places are few bytes for the work that they stand for
    placed = cut.where(F.col("strip") * step < F.col("h")).repartition(parts, key, "strip")
    return placed.groupBy(key, "strip").applyInArrow(merge, f"{key} long, y long, {result}")


def _as_arrays(lines: np.ndarray) -> list[pa.Array]:
    """The rows of a matrix as one column of arrays."""
    return [pa.ListArray.from_arrays(pa.array(np.arange(len(lines) + 1, dtype=np.int32) * lines.shape[1]), pa.array(lines.reshape(-1)))]
