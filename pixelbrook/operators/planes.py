"""Operators on pixel tables ``(y, x, channels)`` and planes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a band; bands overlap by a row, so windows over columns never gather a whole column in one task.
BAND = 64


def _banded(px: DataFrame, above: int, below: int) -> DataFrame:
    """Each row with its band, and again in the next or last band where that needs so many rows above or below its own;
    ``own``: the row's own band."""
    band = F.floor(F.col("y") / BAND)
    place = F.pmod(F.col("y"), F.lit(BAND))
    bands = [band]
    if above:
        bands.append(F.when(place >= BAND - above, band + 1))
    if below:
        bands.append(F.when(place < below, band - 1))
    return px.withColumn("own", band).withColumn("band", F.explode(F.array_compact(F.array(*bands))))


def neighbours(px: DataFrame, channel: str) -> DataFrame:
    """``(y, x, channel)`` with the pixels to the left, on top, in the corner between them and to the right of the top;
    null where there is none. A shuffle by bands of rows and two windows, no join."""
    row = Window.partitionBy("band", "y").orderBy("x").rangeBetween
    out = _banded(px, 1, 0)
    at = lambda d: F.max(channel).over(row(d, d))
    out = out.withColumns({"left": at(-1), "next": at(1)})
    column = Window.partitionBy("band", "x").orderBy("y").rangeBetween(-1, -1)
    out = out.withColumns({"top": F.max(channel).over(column), "corner": F.max("left").over(column), "right": F.max("next").over(column)})
    return out.where("band = own").drop("next", "band", "own")


def palette(px: DataFrame, image: str, colour: str) -> DataFrame:
    """``(image, colour, idx, uses)``: the different colours of each image in order."""
    order = Window.partitionBy(image).orderBy(colour)
    return px.groupBy(image, colour).agg(F.count("*").alias("uses")).withColumn("idx", (F.row_number().over(order) - 1).cast("int"))


def packed(px: DataFrame, y: str, x: str, idx: str, bits: int) -> DataFrame:
    """Palette indices of ``bits`` bits packed, least first, into words of 8 bits."""
    per = 8 // bits
    place = (F.col(x) % per).cast("int") * bits
    return px.groupBy(y, F.floor(F.col(x) / per).cast("int").alias("word")).agg(F.sum((F.col(idx) * F.pow(F.lit(2), place)).cast("long")).alias("packed"))


def histograms(px: DataFrame, channels: str) -> DataFrame:
    """``(channel, value, n)`` of all channels in one aggregation: each pixel's channels become rows before the partial sums."""
    rows = px.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in channels])).alias("v"))
    return rows.groupBy(F.col("v.channel").alias("channel"), F.col("v.value").alias("value")).agg(F.count("*").alias("n"))


def filtered(plane: DataFrame, y: str, x: str, value: str) -> DataFrame:
    """Horizontal prediction: each value less the one to its left (0 before the first), modulo 256."""
    left = F.coalesce(F.lag(value).over(Window.partitionBy(y).orderBy(x)), F.lit(0))
    return plane.withColumn("residual", (F.col(value) - left).bitwiseAND(255))


def unfiltered(plane: DataFrame, y: str, x: str) -> DataFrame:
    """The values back from residuals: a running sum along each row, modulo 256."""
    run = Window.partitionBy(y).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    return plane.withColumn("back", F.sum("residual").over(run).bitwiseAND(255).cast("int"))


def smoothed(px: DataFrame, size: int, width: int | None = None, height: int | None = None) -> DataFrame:
    """Transparent pixels of a block that has others take those others' mean. One shuffle by block; a block has at most
    size x size pixels. With the image's ``width`` and ``height``, whole blocks without any other pixel are flattened: along a
    row of blocks, all of a run of such blocks take the colour of the first one's first pixel."""
    by, bx = F.floor(F.col("y") / size), F.floor(F.col("x") / size)
    block = Window.partitionBy(by, bx)
    opaque = F.col("a") != 0
    n = F.count(F.when(opaque, 1)).over(block)
    mean = lambda c: F.floor(F.sum(F.when(opaque, F.col(c))).over(block) / n).cast("int")
    out = px.select("y", "x", *[F.when(F.col("a") == 0, F.coalesce(mean(c), F.col(c))).otherwise(F.col(c)).alias(c) for c in "rgb"], "a")
    if width is None or height is None:
        return out
    whole = ((by + 1) * size <= height) & ((bx + 1) * size <= width)
    first = F.min_by(F.struct(*"rgb"), F.struct("y", "x"))
    blocks = px.groupBy(by.alias("by"), bx.alias("bx")).agg((F.max("a") == 0).alias("clear"), first.alias("colour")).where("clear").where(((F.col("by") + 1) * size <= height) & ((F.col("bx") + 1) * size <= width))
    row = Window.partitionBy("by").orderBy("bx")  # a row of blocks, one small row each
    run = blocks.withColumn("run", F.col("bx") - F.row_number().over(row))
    carried = run.select("by", "bx", F.first("colour").over(Window.partitionBy("by", "run").orderBy("bx")).alias("carried"))
    both = out.withColumns({"by": by, "bx": F.when(whole, bx)}).join(carried, ["by", "bx"], "left")
    return both.select("y", "x", *[F.coalesce(F.col("carried")[c], F.col(c)).alias(c) for c in "rgb"], "a")


def majority(blocks: DataFrame, segment: str, n_segments: int) -> DataFrame:
    """``smooth``: the segment that at least five of the nine blocks around (y, x) have, else its own; blocks at the border keep
    theirs. Counts by segment add up along rows, then along columns of a band."""
    row = Window.partitionBy("band", "y").orderBy("x").rangeBetween(-1, 1)
    column = Window.partitionBy("band", "x").orderBy("y").rangeBetween(-1, 1)
    out = _banded(blocks, 1, 1)
    names = [f"n{s}" for s in range(n_segments)]
    out = out.withColumns({n: F.sum((F.col(segment) == s).cast("int")).over(row) for s, n in enumerate(names)})
    out = out.withColumns({n: F.sum(n).over(column) for n in names})
    best = reduce(lambda a, s: F.when(F.col(names[s]) >= 5, s).otherwise(a), range(n_segments), F.col(segment))
    best = F.when(reduce(lambda a, b: a + b, map(F.col, names)) == 9, best).otherwise(F.col(segment))
    return out.where("band = own").select("y", "x", segment, best.cast("int").alias("smooth"))


def _at(order: str, *keys: str):
    """``f(column, d)``: the column d places on, null where there is no such place."""
    window = Window.partitionBy(*keys).orderBy(order)
    return lambda c, d: F.max(c).over(window.rangeBetween(d, d))


def near_lossless_pass(px: DataFrame, channels: str, bits: int) -> DataFrame:
    """Inner pixels that differ from a neighbour by 2^bits or more in any channel are rounded to a multiple of 2^bits (ties to
    the even multiple; at most 255); smooth ones and the border stay."""
    row, column = _at("x", "band", "y"), _at("y", "band", "x")
    out = _banded(px, 1, 1)
    sides = {f"{c}{n}": f(c, d) for c in channels for n, f, d in (("l", row, -1), ("r", row, 1), ("u", column, -1), ("d", column, 1))}
    out = out.withColumns(sides)
    smooth = reduce(lambda a, b: a & b, [F.abs(F.col(c) - F.col(f"{c}{n}")) < (1 << bits) for c in channels for n in "lrud"])
    mask = (1 << bits) - 1

    def rounded(c):
        biased = F.col(c) + (mask >> 1) + F.shiftright(F.col(c), bits).bitwiseAND(1)
        return F.when(biased > 255, 255).otherwise(biased - biased.bitwiseAND(mask))

    border = reduce(lambda a, b: a | b, [F.col(f"{channels[0]}{n}").isNull() for n in "lrud"])
    return out.where("band = own").select("y", "x", *[F.when(border | smooth, F.col(c)).otherwise(rounded(c)).cast("int").alias(c) for c in channels])


def near_lossless(px: DataFrame, channels: str, width: int, height: int, quality: int) -> DataFrame:
    """Passes from 5 - quality / 20 bits down to one. Images under 64 pixels both ways, or three rows, stay."""
    bits = 5 - quality // 20
    if bits <= 0 or height < 3 or width < 64 and height < 64:
        return px.select("y", "x", *channels)
    for k in range(bits, 0, -1):
        px = near_lossless_pass(px, channels, k)
    return px


#: The hat-shaped weights of the similarity window (fixed values).
HAT = (1, 2, 3, 4, 3, 2, 1)


def structural_similarity(px: DataFrame, a: str, b: str) -> DataFrame:
    """``ssim`` of planes a and b around each pixel, in integers: a 7 x 7 window with hat-shaped weights, cut at the border.
    Weighted sums run along rows, then along columns of bands."""
    terms = {"n": F.lit(1), "xm": F.col(a), "ym": F.col(b), "xx": F.col(a) * F.col(a), "xy": F.col(a) * F.col(b), "yy": F.col(b) * F.col(b)}
    out = _banded(px, 3, 3).withColumns({k: v.cast("long") for k, v in terms.items()})
    for at in (_at("x", "band", "y"), _at("y", "band", "x")):
        out = out.withColumns({k: sum((w * F.coalesce(at(k, d), F.lit(0).cast("long")) for d, w in zip(range(-3, 4), HAT)), F.lit(0).cast("long")) for k in terms})
    n, xm, ym, xx, xy, yy = (F.col(k) for k in terms)
    w2 = n * n
    sxy = F.greatest(xy * n - xm * ym, F.lit(0).cast("long"))
    top, bottom = F.shiftright(2 * sxy + 60 * w2, 8), F.shiftright(xx * n - xm * xm + yy * n - ym * ym + 60 * w2, 8)
    value = ((2 * xm * ym + 20 * w2) * top).cast("double") / ((xm * xm + ym * ym + 20 * w2) * bottom).cast("double")
    return out.where("band = own").select("y", "x", F.when(xm * xm + ym * ym < 64 * w2, 1.0).otherwise(value).alias("ssim"))


def upsampled(chroma: DataFrame, c: str) -> DataFrame:
    """A chroma plane at twice its size: (9, 3, 3, 1) / 16 of the nearest value, those beside it and the diagonal one; a
    missing neighbour counts as the nearest value."""
    row = _at("x", "band", "y")
    out = _banded(chroma, 1, 1).withColumns({"l": F.coalesce(row(c, -1), F.col(c)), "r": F.coalesce(row(c, 1), F.col(c))})
    column = _at("y", "band", "x")
    out = out.withColumns({f"{n}{k}": F.coalesce(column(k, d), F.col(k)) for k in (c, "l", "r") for n, d in (("u", -1), ("d", 1))}).where("band = own")
    cells = []
    for dy, v in ((0, "u"), (1, "d")):
        for dx, h in ((0, "l"), (1, "r")):
            value = F.shiftright(9 * F.col(c) + 3 * F.col(h) + 3 * F.col(f"{v}{c}") + F.col(f"{v}{h}") + 8, 4)
            cells.append(F.struct((F.col("y") * 2 + dy).alias("y"), (F.col("x") * 2 + dx).alias("x"), value.cast("int").alias("v")))
    return out.select(F.explode(F.array(*cells)).alias("p")).select("p.*")


def chroma_sums(px: DataFrame, *keys: str) -> DataFrame:
    """``(keys..., by, bx, r4, g4, b4, a4)``: averages of 2 x 2 blocks in linear light, times four, each pixel weighed by its alpha where
    some but not all of the block is transparent; blocks at an odd edge count their pixels twice. Partial sums before the shuffle."""
    linear = lambda c: F.floor(F.pow(F.col(c) / 255.0, F.lit(0.8)) * 4095 + 0.5).cast("long")
    tab = lambda k: F.floor(F.pow(k * (128.0 / 4095), F.lit(1.25)) * 255 + 0.5).cast("long")
    sums = px.groupBy(*keys, F.floor(F.col("y") / 2).alias("by"), F.floor(F.col("x") / 2).alias("bx")).agg(
        F.count("*").alias("n"), F.sum("a").alias("a4"), *[F.sum(linear(c)).alias(f"s{c}") for c in "rgb"], *[F.sum(F.col("a") * linear(c)).alias(f"w{c}") for c in "rgb"]
    )
    times = F.floor(F.lit(4) / F.col("n"))
    alpha = F.col("a4") * times

    def averaged(c):
        weighed = F.shiftright(F.col(f"w{c}") * times * F.floor(F.lit(1 << 19) / F.greatest(alpha, F.lit(1))), 17)
        v = F.when((alpha == 0) | (alpha == 1020), F.col(f"s{c}") * times).otherwise(weighed)
        at, on = F.least(F.shiftright(v, 9), F.lit(31)), v.bitwiseAND(511)
        return F.shiftright(tab(at + 1) * on + tab(at) * (512 - on) + 64, 7).cast("int")

    return sums.select(*keys, "by", "bx", *[averaged(c).alias(f"{c}4") for c in "rgb"], alpha.cast("int").alias("a4"))


def translucent(px: DataFrame, image: str) -> DataFrame:
    """``(image, has_alpha, alphas)``: whether any pixel isn't opaque, and how many different alphas there are."""
    return px.groupBy(image).agg((F.min("a") < 255).alias("has_alpha"), F.countDistinct("a").alias("alphas"))


def segment_centres(alphas: DataFrame, image: str, alpha: str, n_segments: int = 4) -> DataFrame:
    """``(image, alpha, segment, centre)``: one-dimensional k-means of each image's values 0..255 in at most six rounds, from
    centres spread evenly, until they move by less than 5 in all. A value goes to the nearest centre, at a tie to the lower;
    a centre without values stays. A histogram, at most 256 rows an image, is what a task gets."""
    import numpy as np
    import pandas as pd

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        values, weights = rows[alpha].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        low, high = values.min(), values.max()
        centres = low + (2 * np.arange(n_segments) + 1) * (high - low) // (2 * n_segments)
        for _ in range(6):
            # sorted centres: a value passes a centre when twice of it is over the sum of that and the next
            of = np.searchsorted(centres[:-1] + centres[1:], 2 * values, side="left")
            n = np.bincount(of, weights, n_segments).astype(np.int64)
            total = np.bincount(of, weights * values, n_segments).astype(np.int64)
            before, centres = centres, np.where(n > 0, (total + n // 2) // np.maximum(n, 1), centres)
            if np.abs(centres - before).sum() < 5:
                break
        return pd.DataFrame({image: rows[image], alpha: rows[alpha], "segment": of.astype(np.int32), "centre": centres[of].astype(np.int32)})

    hist = alphas.groupBy(image, alpha).agg(F.count("*").alias("n"))
    kinds = {f.name: f.dataType.simpleString() for f in hist.schema}
    return hist.groupBy(image).applyInPandas(cluster, f"{image} {kinds[image]}, {alpha} {kinds[alpha]}, segment int, centre int")
