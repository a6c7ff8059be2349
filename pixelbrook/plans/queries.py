"""The engine's own queries over the driver's tables, and the SQL that must give the same rows.

The tables hold no images, so pixels, chunks and frames are derived from their integers: exactly the same way in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import options as O
from ..functions import pixels as P

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def i(c: Column) -> Column:
    return c.cast("int")


# ---------------------------------------------------------------- derived tables

#: A pixel of each line item, keyed by order and line.
PIXEL_SQL = """px AS (SELECT l_orderkey AS y, l_linenumber AS x, CAST(l_partkey % 256 AS INT) AS r, CAST(l_suppkey * 7 % 256 AS INT) AS g,
  CAST((l_partkey * 3 + l_orderkey) % 256 AS INT) AS b, CAST(CASE WHEN l_orderkey % 5 = 0 THEN 0 WHEN l_orderkey % 3 = 0 THEN l_partkey % 256 ELSE 255 END AS INT) AS a FROM lineitem)"""


def pixels(spark, sf_dir: str) -> DataFrame:
    k, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        k.alias("y"), F.col("l_linenumber").alias("x"), i(p % 256).alias("r"), i(s * 7 % 256).alias("g"), i((p * 3 + k) % 256).alias("b"),
        i(F.when(k % 5 == 0, 0).when(k % 3 == 0, p % 256).otherwise(255)).alias("a"),
    )


#: Pixels at places of their own: of line items that share a place, the least of each channel.
GRID_SQL = PIXEL_SQL + ", gr AS (SELECT y, x, min(r) AS r, min(g) AS g, min(b) AS b, min(a) AS a FROM px GROUP BY y, x)"


def grid(spark, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).groupBy("y", "x").agg(*[F.min(c).alias(c) for c in "rgba"])


#: A frame of each event: one animation for each user, in the order of (ts, event_id); canvas 320 x 200.
FRAME_SQL = """fr AS (SELECT user_id AS anim_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
  CASE WHEN event_id % 4 = 0 THEN 0 ELSE 2 * (event_id % 50) END AS x, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 2 * (event_id % 40) END AS y,
  CASE WHEN event_id % 4 = 0 THEN 320 ELSE 1 + event_id % 200 END AS w, CASE WHEN event_id % 4 = 0 THEN 200 ELSE 1 + event_id % 120 END AS h,
  event_id % 250 AS duration_ms, event_id % 3 = 0 AS has_alpha, event_id % 7 = 0 AS no_blend, event_id % 5 = 0 AS to_background, event_type FROM events)"""


def frames(spark, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    full = e % 4 == 0
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("anim_id"), "event_id", "ts", (F.row_number().over(order) - 1).cast("long").alias("frame_idx"),
        F.when(full, 0).otherwise(2 * (e % 50)).alias("x"), F.when(full, 0).otherwise(2 * (e % 40)).alias("y"), F.when(full, 320).otherwise(1 + e % 200).alias("w"), F.when(full, 200).otherwise(1 + e % 120).alias("h"),
        (e % 250).alias("duration_ms"), (e % 3 == 0).alias("has_alpha"), (e % 7 == 0).alias("no_blend"), (e % 5 == 0).alias("to_background"), "event_type",
    )


# ---------------------------------------------------------------- containers


@query("""SELECT doc_id, strlen(text) AS size, strlen(text) + strlen(text) % 2 AS padded, 12 + strlen(text) + strlen(text) % 2 AS riff_size, 'VP8L' AS fourcc,
 20 + strlen(text) + strlen(text) % 2 AS file_size, CAST(NULL AS VARCHAR) AS error FROM documents""")
def riff_wrap_sizes(spark, sf_dir):
    """Wrap each text as a chunk of a file, and read the file's fields back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("p"))
    docs = docs.select("doc_id", B.riff(B.chunk("VP8L", F.col("p"))).alias("f"))
    f = F.col("f")
    size = B.unsigned(f, 16, 4)
    return docs.select("doc_id", size.alias("size"), B.padded(size).alias("padded"), B.unsigned(f, 4, 4).alias("riff_size"), B.fourcc(f, 12).alias("fourcc"), F.length(f).cast("long").alias("file_size"), B.riff_error(f).alias("error"))


@query("""SELECT doc_id, CAST(doc_id % 16383 + 1 AS INT) AS width, CAST(doc_id * 7 % 16383 + 1 AS INT) AS height, doc_id % 2 = 1 AS has_alpha, 'lossless' AS format,
 CAST(NULL AS VARCHAR) AS error FROM documents""")
def probe_lossless(spark, sf_dir):
    d = F.col("doc_id")
    head = B.lossless_header_bytes(d % 16383 + 1, d * 7 % 16383 + 1, d % 2)
    files = table(spark, sf_dir, "documents").select("doc_id", B.riff(B.chunk("VP8L", head)).alias("f"))
    return files.select("doc_id", B.probe(F.col("f")).alias("p")).select("doc_id", "p.width", "p.height", "p.has_alpha", "p.format", "p.error")


@query("""SELECT page_id, CAST(page_id * 11 % 16383 + 1 AS INT) AS width, CAST(page_id * 5 % 16383 + 1 AS INT) AS height, FALSE AS has_alpha, 'lossy' AS format,
 CAST(NULL AS VARCHAR) AS error FROM pages""")
def probe_lossy(spark, sf_dir):
    d = F.col("page_id")
    head = B.lossy_header_bytes(d * 11 % 16383 + 1, d * 5 % 16383 + 1)
    files = table(spark, sf_dir, "pages").select("page_id", B.riff(B.chunk("VP8 ", head)).alias("f"))
    return files.select("page_id", B.probe(F.col("f")).alias("p")).select("page_id", "p.width", "p.height", "p.has_alpha", "p.format", "p.error")


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'truncated' WHEN 1 THEN 'not a RIFF file' WHEN 2 THEN 'not a RIFF file' WHEN 3 THEN 'unknown form type' WHEN 4 THEN 'file too large' END AS error FROM documents""")
def riff_errors(spark, sf_dir):
    good = F.concat(F.encode(F.lit("RIFF"), "US-ASCII"), B.little_endian(F.lit(100), 4), F.encode(F.lit("WEBP"), "US-ASCII"))
    bad = {
        0: F.substring(good, F.lit(1), F.lit(9)), 1: F.concat(F.encode(F.lit("RIFX"), "US-ASCII"), F.substring(good, F.lit(5), F.lit(8))), 2: F.concat(F.substring(good, F.lit(1), F.lit(4)), B.little_endian(F.lit(7), 4), F.substring(good, F.lit(9), F.lit(4))),
        3: F.concat(F.substring(good, F.lit(1), F.lit(8)), F.encode(F.lit("WAVE"), "US-ASCII")), 4: F.concat(F.substring(good, F.lit(1), F.lit(4)), F.unhex(F.lit("FFFFFFFF")), F.substring(good, F.lit(9), F.lit(4))),
    }
    data = good
    for k, v in bad.items():
        data = F.when(F.col("doc_id") % 6 == k, v).otherwise(data)
    return table(spark, sf_dir, "documents").select("doc_id", B.riff_error(data).alias("error"))


@query("""SELECT event_id, 2 * ((event_id * 13 % 5000) // 2) AS x, 2 * ((event_id * 17 % 5000) // 2) AS y, event_id % 900 + 1 AS w, event_id % 700 + 1 AS h, event_id * 31 % 16777216 AS duration_ms,
 CAST(event_id % 2 AS INT) AS dispose, CAST(event_id // 2 % 2 AS INT) AS no_blend FROM events""")
def frame_header_roundtrip(spark, sf_dir):
    e = F.col("event_id")
    head = B.frame_header_bytes(e * 13 % 5000, e * 17 % 5000, e % 900 + 1, e % 700 + 1, e * 31 % 16777216, e % 2, F.floor(e / 2) % 2)
    # the bytes are a column of their own, so that they are made once and not for each byte that is read
    return table(spark, sf_dir, "events").select("event_id", head.alias("p")).select("event_id", B.frame_header(F.col("p")).alias("h")).select("event_id", "h.*")


@query("""SELECT d.doc_id, CAST((CASE WHEN d.doc_id % 4 = 0 THEN 2 ELSE 0 END) + (CASE WHEN l.toxic = 1 THEN 4 ELSE 0 END) + (CASE WHEN l.quality = 1 THEN 8 ELSE 0 END) + (CASE WHEN l.doc_id IS NOT NULL THEN 32 ELSE 0 END) AS BIGINT) AS flags,
 d.doc_id % 1000 + 1 AS width, d.doc_id % 600 + 1 AS height FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def extended_flags(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "of")
    d = F.col("doc_id")
    both = docs.join(labels, d == F.col("of"), "left")
    flags = B.extended_flags(animation=d % 4 == 0, xmp=F.col("toxic") == 1, exif=F.col("quality") == 1, icc=F.col("of").isNotNull())
    both = both.select("doc_id", B.extended_header_bytes(flags, d % 1000 + 1, d % 600 + 1).alias("p"))
    p = F.col("p")
    return both.select("doc_id", B.unsigned(p, 0, 4).alias("flags"), (B.unsigned(p, 4, 3) + 1).alias("width"), (B.unsigned(p, 7, 3) + 1).alias("height"))


@query("""WITH c AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'EXIF' WHEN 'user' THEN 'XMP ' ELSE 'ICCP' END AS fourcc, strlen(text) AS size FROM conversations)
SELECT conv_id, CAST(row_number() OVER o AS INT) AS idx, fourcc, CAST(30 + coalesce(sum(8 + size + size % 2) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", size FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn)""")
def chunk_offsets(spark, sf_dir):
    """Files of the turns of each conversation, behind an extended header and before an image, walked chunk by chunk."""
    from ..sources.tables import chunks

    tag = F.when(F.col("role") == "system", "EXIF").when(F.col("role") == "user", "XMP ").otherwise("ICCP")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.hex(B.chunk(tag, F.col("text").cast("binary"))).alias("c"))
    lists = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "c"))).alias("cs"))
    body = F.unhex(F.array_join(F.transform("cs", lambda c: c["c"]), ""))
    head = B.chunk("VP8X", B.extended_header_bytes(F.lit(0), F.lit(1), F.lit(1)))
    files = lists.select("conv_id", B.riff(head, body, B.chunk("VP8L", B.lossless_header_bytes(F.lit(1), F.lit(1), F.lit(0)))).alias("content"))
    return chunks(files, "conv_id").where("fourcc not in ('VP8X', 'VP8L')").select("conv_id", "idx", "fourcc", "offset", "size")


# ---------------------------------------------------------------- animations


@query(f"""WITH {FRAME_SQL} SELECT anim_id, event_id, frame_idx, duration_ms, CAST(sum(duration_ms) OVER (PARTITION BY anim_id ORDER BY frame_idx) - duration_ms AS BIGINT) AS start_ms FROM fr""")
def frame_timeline(spark, sf_dir):
    from ..operators.animation import timeline

    return timeline(frames(spark, sf_dir)).select("anim_id", "event_id", "frame_idx", "duration_ms", "start_ms")


@query(f"""WITH {FRAME_SQL} SELECT anim_id, count(*) AS n_frames, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, bool_or(has_alpha) AS has_alpha, count(*) > 1 OR max(duration_ms) > 0 AS is_animated,
 greatest(max(x + w), 1) AS canvas_w, greatest(max(y + h), 1) AS canvas_h, bool_and(x + w <= 320 AND y + h <= 200) AS fits FROM fr GROUP BY anim_id""")
def animation_summary(spark, sf_dir):
    from ..operators.animation import summary

    return summary(frames(spark, sf_dir), 320, 200)


@query("""SELECT event_id, CAST(least(greatest(event_id * 977 % 200000 - 50000, 0), 65535) AS BIGINT) AS loop_count, CAST(least(greatest(event_id * 65537 % 40000000 - 5000000, 0), 16777215) AS BIGINT) AS duration_ms,
 CAST(least(greatest(event_id * 4099 % 50000000 - 1000, 0), 16777216) AS BIGINT) AS canvas FROM events""")
def clamped_fields(spark, sf_dir):
    from ..operators.mux import clamped

    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", clamped(e * 977 % 200000 - 50000, "loop").alias("loop_count"), clamped(e * 65537 % 40000000 - 5000000, "duration").alias("duration_ms"), clamped(e * 4099 % 50000000 - 1000, "canvas").alias("canvas"))


@query(f"""WITH {FRAME_SQL}, s AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY anim_id ORDER BY frame_idx) THEN 0 ELSE 1 END AS new FROM fr),
g AS (SELECT *, sum(new) OVER (PARTITION BY anim_id ORDER BY frame_idx) AS run FROM s)
SELECT anim_id, min(frame_idx) AS frame_idx, min(event_type) AS canvas, count(*) AS merged, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM g GROUP BY anim_id, run""")
def identical_frames_merged(spark, sf_dir):
    from ..operators.animation import merge_identical

    return merge_identical(frames(spark, sf_dir), "event_type").select("anim_id", "frame_idx", F.col("event_type").alias("canvas"), "merged", "duration_ms")


@query(f"""WITH RECURSIVE {FRAME_SQL}, k AS (
 SELECT anim_id, frame_idx, event_id, TRUE AS is_key, to_background AS gone, (x = 0 AND y = 0 AND w = 320 AND h = 200) AS whole FROM fr WHERE frame_idx = 0
 UNION ALL
 SELECT f.anim_id, f.frame_idx, f.event_id, ((f.x = 0 AND f.y = 0 AND f.w = 320 AND f.h = 200) AND (NOT f.has_alpha OR f.no_blend)) OR (k.gone AND (k.whole OR k.is_key)), f.to_background, (f.x = 0 AND f.y = 0 AND f.w = 320 AND f.h = 200)
 FROM k JOIN fr f ON f.anim_id = k.anim_id AND f.frame_idx = k.frame_idx + 1)
SELECT anim_id, frame_idx, event_id, is_key FROM k""")
def keyframe_flags(spark, sf_dir):
    from ..operators.animation import keyframes

    return keyframes(frames(spark, sf_dir), 320, 200).select("anim_id", "frame_idx", "event_id", "is_key")


@query("""SELECT event_id, x0 - x0 % 2 AS x0, y0 - y0 % 2 AS y0, x1, y1 FROM (SELECT event_id, event_id * 3 % 301 AS x0, event_id * 5 % 173 AS y0, event_id * 3 % 301 + 1 + event_id % 40 AS x1, event_id * 5 % 173 + 1 + event_id % 60 AS y1 FROM events)""")
def even_rects(spark, sf_dir):
    e = F.col("event_id")
    x0, y0 = e * 3 % 301, e * 5 % 173
    rect = P.even_rect(x0, y0, x0 + 1 + e % 40, y0 + 1 + e % 60)
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for c, n in zip(rect, ("x0", "y0", "x1", "y1"))])


#: Two canvases of each strip of 64 orders: the second one differs where the line's tax is 0.
CANVAS_SQL = """cv AS (SELECT l_orderkey // 64 AS image_id, CAST(l_linenumber AS BIGINT) AS x, l_orderkey % 64 AS y, CAST(l_partkey % 256 AS INT) AS r0, CAST(CASE WHEN l_tax = 0 AND l_orderkey % 3 = 0 THEN (l_partkey + l_linenumber * 9) % 256 ELSE l_partkey % 256 END AS INT) AS r1,
 CAST(CASE WHEN l_orderkey % 640 < 400 THEN 255 ELSE l_suppkey * 37 % 256 END AS INT) AS a1 FROM lineitem)"""


def canvases(spark, sf_dir: str) -> DataFrame:
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.floor(k / 64).alias("image_id"), F.col("l_linenumber").cast("long").alias("x"), (k % 64).alias("y"), i(p % 256).alias("r0"),
        i(F.when((F.col("l_tax") == 0) & (k % 3 == 0), (p + F.col("l_linenumber") * 9) % 256).otherwise(p % 256)).alias("r1"), i(F.when(k % 640 < 400, 255).otherwise(F.col("l_suppkey") * 37 % 256)).alias("a1"),
    )


@query(f"""WITH {CANVAS_SQL} SELECT image_id, min(x) FILTER (r0 <> r1) AS x0, min(y) FILTER (r0 <> r1) AS y0, max(x) FILTER (r0 <> r1) + 1 AS x1, max(y) FILTER (r0 <> r1) + 1 AS y1, count(*) FILTER (r0 <> r1) AS changed,
 bool_and(a1 = 255 OR r0 = r1) AS lossless_blend, bool_and(a1 = 255 OR abs(r0 - r1) * a1 <= 5 * 255) AS lossy_blend FROM cv GROUP BY image_id""")
def changed_rects(spark, sf_dir):
    """Bounds of the changed pixels, and whether blending could give the new canvas."""
    from ..operators.animation import changed_rect

    c = canvases(spark, sf_dir)
    before, after = ({"r": F.col(n), "g": F.lit(0), "b": F.lit(0), "a": F.col("a1")} for n in ("r0", "r1"))
    return changed_rect(c, "image_id", before, after, most=F.lit(5))


# ---------------------------------------------------------------- colours


@query(f"""WITH {PIXEL_SQL} SELECT y, x, (16839 * r + 33059 * g + 6420 * b + 1081344) >> 16 AS luma, least(greatest((-9719 * 4 * r - 19081 * 4 * g + 28800 * 4 * b + 33685504) >> 18, 0), 255) AS u,
 least(greatest((28800 * 4 * r - 24116 * 4 * g - 4684 * 4 * b + 33685504) >> 18, 0), 255) AS v FROM px""")
def rgb_to_yuv(spark, sf_dir):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return pixels(spark, sf_dir).select("y", "x", P.luma(r, g, b).alias("luma"), P.chroma(4 * r, 4 * g, 4 * b, "u").alias("u"), P.chroma(4 * r, 4 * g, 4 * b, "v").alias("v"))


_VIDEO = {"red": "(r * 19077 >> 8) + (b * 26149 >> 8) - 14234", "green": "(r * 19077 >> 8) - (g * 6419 >> 8) - (b * 13320 >> 8) + 8708", "blue": "(r * 19077 >> 8) + (g * 33050 >> 8) - 17685"}
_JFIF = {"jred": "(r * 65793 + 91881 * (b - 128)) >> 16", "jgreen": "(r * 65793 - 22554 * (g - 128) - 46802 * (b - 128)) >> 16", "jblue": "(r * 65793 + 116130 * (g - 128)) >> 16"}


@query(f"WITH {PIXEL_SQL} SELECT y, x, " + ", ".join([*(f"least(greatest({e}, 0), 16383) >> 6 AS {n}" for n, e in _VIDEO.items()), *(f"least(greatest({e}, 0), 255) AS {n}" for n, e in _JFIF.items())]) + " FROM px")
def yuv_to_rgb(spark, sf_dir):
    """The pixels' channels read as Y, U and V, in both conventions."""
    c = [F.col(n) for n in "rgb"]
    return pixels(spark, sf_dir).select("y", "x", *[v.alias(n) for n, v in zip(_VIDEO, P.yuv_to_rgb(*c, range="video"))], *[v.alias(n) for n, v in zip(_JFIF, P.yuv_to_rgb(*c, range="jfif"))])


_MATRIX_SQL = """('native', 16839, 33059, 6420, 1048576, -9719, -19081, 28800, 8388608, 28800, -24116, -4684, 8388608), ('rec601_limited', 16829, 33039, 6416, 1048576, -9714, -19071, 28784, 8388608, 28784, -24103, -4681, 8388608),
 ('rec601_full', 19595, 38470, 7471, 0, -11058, -21710, 32768, 8388608, 32768, -27439, -5329, 8388608), ('rec709_limited', 11966, 40254, 4064, 1048576, -6596, -22189, 28784, 8388608, 28784, -26145, -2639, 8388608),
 ('rec709_full', 13933, 46871, 4732, 0, -7509, -25259, 32768, 8388608, 32768, -29763, -3005, 8388608)"""


@query(f"""WITH {PIXEL_SQL}, m(matrix, a0, a1, a2, a3, b0, b1, b2, b3, c0, c1, c2, c3) AS (VALUES {_MATRIX_SQL})
SELECT matrix, count(*) AS n, CAST(sum((a0 * r + a1 * g + a2 * b + a3 + 32768) >> 16) AS BIGINT) AS sum_y, CAST(sum((b0 * r + b1 * g + b2 * b + b3 + 32768) >> 16) AS BIGINT) AS sum_u, CAST(sum((c0 * r + c1 * g + c2 * b + c3 + 32768) >> 16) AS BIGINT) AS sum_v
FROM px CROSS JOIN m GROUP BY matrix""")
def colour_matrices(spark, sf_dir):
    """Sums of each plane under each matrix: one pass, an aggregate for each matrix, no join."""
    c = [F.col(n) for n in "rgb"]
    sums = F.array(*[F.struct(F.lit(n).alias("matrix"), F.count(F.lit(1)).alias("n"), *[F.sum(P.matrix_row(*c, row).cast("long")).alias(f"sum_{k}") for k, row in zip("yuv", m)]) for n, m in P.MATRICES.items()])
    return pixels(spark, sf_dir).agg(sums.alias("s")).select(F.explode("s").alias("s")).select("s.*")


@query(f"""WITH {PIXEL_SQL} SELECT y // 2 AS by, CAST(x // 2 AS INT) AS bx, CAST(sum(r) AS BIGINT) AS r4, CAST(sum(g) AS BIGINT) AS g4, CAST(sum(b) AS BIGINT) AS b4, count(*) AS n FROM px GROUP BY 1, 2""")
def chroma_blocks(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy(F.floor(F.col("y") / 2).alias("by"), F.floor(F.col("x") / 2).cast("int").alias("bx")).agg(F.sum("r").alias("r4"), F.sum("g").alias("g4"), F.sum("b").alias("b4"), F.count("*").alias("n"))


@query(f"""WITH {PIXEL_SQL} SELECT y // 512 AS image_id, CAST(sum((r - g) * (r - g)) AS BIGINT) AS sse, count(*) AS n,
 round(CASE WHEN sum((r - g) * (r - g)) = 0 THEN 99.0 ELSE 10.0 * log10(65025.0 * count(*) / sum((r - g) * (r - g))) END, 6) AS psnr FROM px GROUP BY 1""")
def plane_psnr(spark, sf_dir):
    d = (F.col("r") - F.col("g")) * (F.col("r") - F.col("g"))
    out = pixels(spark, sf_dir).groupBy(F.floor(F.col("y") / 512).alias("image_id")).agg(F.sum(d).alias("sse"), F.count("*").alias("n"))
    return out.select("image_id", "sse", "n", F.round(P.psnr(F.col("sse"), F.col("n")), 6).alias("psnr"))


@query(f"""WITH {PIXEL_SQL}, q AS (SELECT *, 255 - r AS sr, 255 - b AS sg, g AS sb, CAST((x * 37 + y) % 256 AS INT) AS sa FROM px),
t AS (SELECT *, (a * (256 - sa)) >> 8 AS f FROM q), s AS (SELECT *, sa + f AS oa, 16777216 // greatest(sa + f, 1) AS sc FROM t)
SELECT y, x, """ + ", ".join(f"CAST(CASE WHEN sa = 0 THEN {c} WHEN sa = 255 OR a = 0 THEN s{c} ELSE least((CAST(s{c} * sa + {c} * f AS BIGINT) * sc) >> 24, 255) END AS INT) AS {c}" for c in "rgb") + ", CAST(CASE WHEN sa = 0 THEN a WHEN sa = 255 OR a = 0 THEN sa ELSE oa END AS INT) AS a FROM s")
def alpha_blend(spark, sf_dir):
    px = pixels(spark, sf_dir)
    dst = {c: F.col(c) for c in "rgba"}
    src = {"r": 255 - dst["r"], "g": 255 - dst["b"], "b": dst["g"], "a": i((F.col("x") * 37 + F.col("y")) % 256)}
    out = P.source_over(src, dst)
    return px.select("y", "x", *[out[c].alias(c) for c in "rgba"])


@query("""SELECT q AS quality, CAST(floor(31.0 * (1.0 - sqrt(q / 100.0)) + sqrt(q / 100.0) + 0.5) AS INT) AS most_difference, CAST(CASE WHEN q >= 100 THEN 256 WHEN q <= 70 THEN 2 + q // 5 ELSE 16 + (q - 70) * 8 END AS INT) AS alpha_levels,
 CAST(CASE WHEN q <= 0 THEN 127 WHEN q >= 100 THEN 0 ELSE least(greatest(floor(127.0 * (1.0 - pow(CASE WHEN q / 100.0 < 0.75 THEN q / 100.0 * (2.0 / 3.0) ELSE 2.0 * (q / 100.0) - 1.0 END, 1.0 / 3.0))), 0), 127) END AS INT) AS quality_index
FROM (SELECT CAST(range AS INT) AS q FROM range(101))""")
def quality_maps(spark, sf_dir):
    q = F.col("quality")
    return spark.range(101).select(i(F.col("id")).alias("quality")).select("quality", P.most_difference(q).alias("most_difference"), P.alpha_levels(q).alias("alpha_levels"), P.quality_index(q).alias("quality_index"))


# ---------------------------------------------------------------- lossless transforms


@query(f"""WITH {PIXEL_SQL} SELECT y, x, (r - g) & 255 AS red, (b - g) & 255 AS blue, r AS red_back, b AS blue_back FROM px""")
def green_roundtrip(spark, sf_dir):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    red, blue = P.minus_green(r, g, b)
    back = P.plus_green(red, g, blue)
    return pixels(spark, sf_dir).select("y", "x", red.alias("red"), blue.alias("blue"), back[0].alias("red_back"), back[1].alias("blue_back"))


_S8 = lambda e: f"(({e}) & 255) - CASE WHEN (({e}) & 255) > 127 THEN 256 ELSE 0 END"


@query(f"""WITH {PIXEL_SQL}, m AS (SELECT *, CAST(y % 251 AS INT) AS m1, CAST(y * 3 % 241 AS INT) AS m2, CAST(y * 5 % 239 AS INT) AS m3 FROM px)
SELECT y, x, (r - (({_S8('m1')}) * ({_S8('g')}) >> 5)) & 255 AS red, (b - (({_S8('m2')}) * ({_S8('g')}) >> 5) - (({_S8('m3')}) * ({_S8('r')}) >> 5)) & 255 AS blue, r AS red_back, b AS blue_back FROM m""")
def cross_colour(spark, sf_dir):
    r, g, b, y = (F.col(c) for c in "rgby")
    m = [i(y % 251), i(y * 3 % 241), i(y * 5 % 239)]
    red, blue = P.cross_colour(r, g, b, *m)
    back = P.uncross_colour(red, g, blue, *m)
    return pixels(spark, sf_dir).select("y", "x", red.alias("red"), blue.alias("blue"), back[0].alias("red_back"), back[1].alias("blue_back"))


_NEAR = f"""{GRID_SQL}, n AS (SELECT p.y, p.x, p.g AS here, l.g AS l, t.g AS t, c.g AS c, coalesce(q.g, 0) AS q FROM gr p JOIN gr l ON l.y = p.y AND l.x = p.x - 1 JOIN gr t ON t.y = p.y - 1 AND t.x = p.x JOIN gr c ON c.y = p.y - 1 AND c.x = p.x - 1 LEFT JOIN gr q ON q.y = p.y - 1 AND q.x = p.x + 1)"""
_MODES = {1: "l", 2: "t", 3: "q", 4: "c", 5: "((l + q) // 2 + t) // 2", 6: "(l + c) // 2", 7: "(l + t) // 2", 8: "(c + t) // 2", 9: "(t + q) // 2", 10: "((l + c) // 2 + (t + q) // 2) // 2", 12: "least(greatest(l + t - c, 0), 255)", 13: "least(greatest((l + t) // 2 + CAST(trunc(((l + t) // 2 - c) / 2) AS INT), 0), 255)"}


@query(f"WITH {_NEAR} SELECT y, x, " + ", ".join(f"(here - ({e})) & 255 AS m{k}" for k, e in _MODES.items()) + " FROM n")
def predictor_residuals(spark, sf_dir):
    """Residuals of each predictor that works channel by channel; rows of orders beside each other, by one window over lines."""
    from ..operators.planes import neighbours

    n = neighbours(grid(spark, sf_dir).select("y", "x", "g"), "g")
    near = {c: F.col(c) for c in ("left", "top", "corner", "right")}
    n = n.where("left is not null and top is not null and corner is not null").withColumn("right", F.coalesce("right", F.lit(0)))
    return n.select("y", "x", *[(F.col("g") - P.predicted(k, near["left"], near["top"], near["corner"], near["right"])).bitwiseAND(255).alias(f"m{k}") for k in _MODES])


@query(f"""WITH {PIXEL_SQL} SELECT y, x, CAST(((CAST(a AS BIGINT) << 24) + (r << 16) + (g << 8) + b) AS BIGINT) AS argb, """ + ", ".join(f"((((CAST(a AS BIGINT) << 24) + (r << 16) + (g << 8) + b) * 506832829) & 4294967295) >> {32 - k} AS slot{k}" for k in (1, 6, 11)) + " FROM px")
def colour_cache_slots(spark, sf_dir):
    word = P.argb(*(F.col(c) for c in "argb"))
    return pixels(spark, sf_dir).select("y", "x", word.alias("argb"), *[P.cache_slot(word, k).alias(f"slot{k}") for k in (1, 6, 11)])


@query("""WITH v AS (SELECT DISTINCT l_partkey AS value FROM lineitem UNION SELECT DISTINCT l_orderkey FROM lineitem), h AS (SELECT value, value - 1 AS v, CAST(CASE WHEN value < 2 THEN 0 ELSE length(bin(value - 1)) - 1 END AS INT) AS hi FROM v WHERE value > 0)
SELECT value, CAST(CASE WHEN v < 2 THEN v ELSE 2 * hi + ((v >> greatest(hi - 1, 0)) & 1) END AS INT) AS code, CAST(CASE WHEN v < 2 THEN 0 ELSE greatest(hi - 1, 0) END AS INT) AS bits, CASE WHEN v < 2 THEN 0 ELSE v & ((CAST(1 AS BIGINT) << greatest(hi - 1, 0)) - 1) END AS extra FROM h""")
def prefix_codes(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    values = line.select(F.col("l_partkey").alias("value")).union(line.select("l_orderkey")).distinct().where("value > 0")
    code, bits, extra = P.prefix_code(F.col("value"))
    return values.select("value", code.alias("code"), bits.alias("bits"), extra.alias("extra"))


@query("""SELECT p_size, p_partkey, CAST(dense_rank() OVER (ORDER BY p_size) - 1 AS INT) AS idx, count(*) OVER (PARTITION BY p_size) AS uses FROM part""")
def palette_index(spark, sf_dir):
    """Each colour's place in the sorted palette of an image."""
    from ..operators.planes import palette

    part = table(spark, sf_dir, "part").select(F.lit(0).alias("image_id"), F.col("p_size").alias("argb"), "p_partkey")
    return part.join(palette(part, "image_id", "argb"), ["image_id", "argb"]).select(F.col("argb").alias("p_size"), "p_partkey", "idx", "uses")


@query(f"""WITH {PIXEL_SQL} SELECT y, CAST(x // 4 AS INT) AS word, CAST(sum((r % 4) << (2 * (x % 4))) AS BIGINT) AS packed FROM px GROUP BY 1, 2""")
def palette_pack(spark, sf_dir):
    from ..operators.planes import packed

    return packed(pixels(spark, sf_dir).withColumn("idx", F.col("r") % 4), "y", "x", "idx", 2)


@query(f"""WITH {PIXEL_SQL} SELECT 'a' AS channel, a AS value, count(*) AS n FROM px GROUP BY a UNION ALL SELECT 'r', r, count(*) FROM px GROUP BY r UNION ALL SELECT 'g', g, count(*) FROM px GROUP BY g UNION ALL SELECT 'b', b, count(*) FROM px GROUP BY b""")
def channel_histograms(spark, sf_dir):
    from ..operators.planes import histograms

    return histograms(pixels(spark, sf_dir), "argb")


@query(f"""WITH {GRID_SQL}, f AS (SELECT y, x, r, coalesce(lag(r) OVER w, 0) AS l FROM gr WINDOW w AS (PARTITION BY y ORDER BY x)) SELECT y, x, (r - l) & 255 AS residual, r AS back FROM f""")
def alpha_filter_horizontal(spark, sf_dir):
    """Horizontal filtering of rows and its undoing by a running sum."""
    from ..operators.planes import filtered, unfiltered

    return unfiltered(filtered(grid(spark, sf_dir).select("y", "x", "r"), "y", "x", "r"), "y", "x").select("y", "x", "residual", "back")


@query(f"""WITH {PIXEL_SQL} SELECT y, x, CASE WHEN a = 0 THEN 0 ELSE CAST(((CAST(a AS BIGINT) << 24) + (r << 16) + (g << 8) + b) AS BIGINT) END AS argb, CAST(CASE WHEN a = 0 THEN 0 ELSE r * 255 // a END AS INT) AS own_r FROM px""")
def transparent_cleared(spark, sf_dir):
    a, r, g, b = (F.col(c) for c in "argb")
    return pixels(spark, sf_dir).select("y", "x", F.when(a == 0, F.lit(0).cast("long")).otherwise(P.argb(a, r, g, b)).alias("argb"), P.unmultiplied(r, a).alias("own_r"))


@query(f"""WITH {PIXEL_SQL}, m AS (SELECT y // 8 AS cy, CAST(x // 8 AS INT) AS cx, """ + ", ".join(f"CAST(sum({c}) FILTER (a <> 0) // count(*) FILTER (a <> 0) AS INT) AS m{c}" for c in "rgb") + """ FROM px GROUP BY 1, 2)
SELECT y, x, """ + ", ".join(f"CASE WHEN a = 0 THEN coalesce(m{c}, {c}) ELSE {c} END AS {c}" for c in "rgb") + ", a FROM px JOIN m ON y // 8 = cy AND x // 8 = cx")
def transparent_smoothed(spark, sf_dir):
    """Transparent pixels take the mean of the others of their 8 x 8 block."""
    from ..operators.planes import smoothed

    return smoothed(pixels(spark, sf_dir), 8)


@query(f"""WITH {PIXEL_SQL} SELECT y, x, (r & 248) * 256 + (g >> 2) * 32 + (b >> 3) AS rgb565, (r & 240) * 256 + (g >> 4) * 256 + (b & 240) + (a >> 4) AS rgba4444 FROM px""")
def packed_layouts(spark, sf_dir):
    a, r, g, b = (F.col(c) for c in "argb")
    return pixels(spark, sf_dir).select("y", "x", P.rgb565(r, g, b).alias("rgb565"), P.rgba4444(r, g, b, a).alias("rgba4444"))


@query("""WITH s AS (SELECT p_partkey // 32 AS y, p_partkey % 32 AS x, CAST(p_size // 13 AS INT) AS seg FROM part), n AS (SELECT a.y, a.x, b.seg, count(*) AS c FROM s a JOIN s b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2, 3)
SELECT s.y, s.x, s.seg, CAST(CASE WHEN sum(n.c) = 9 THEN coalesce(max(n.seg) FILTER (n.c >= 5), s.seg) ELSE s.seg END AS INT) AS smooth FROM s JOIN n USING (y, x) GROUP BY s.y, s.x, s.seg""")
def segment_majority(spark, sf_dir):
    """Each inner block's segment becomes that of five or more of the nine around it."""
    from ..operators.planes import majority

    k = F.col("p_partkey")
    return majority(table(spark, sf_dir, "part").select(F.floor(k / 32).alias("y"), (k % 32).alias("x"), i(F.floor(F.col("p_size") / 13)).alias("seg")), "seg", 4)


_E16 = ", ".join(f"CAST(floor(embedding[{k + 1}] * 100) AS INT) AS e{k}" for k in range(16))


def entries(spark, sf_dir: str, n: int) -> DataFrame:
    """The first values of each vector as integers, null where it is shorter. Products are of single precision, as the SQL's are."""
    hundred = F.lit(100).cast("float")
    return table(spark, sf_dir, "embeddings").select("vec_id", *[i(F.floor(F.get("embedding", F.lit(k)) * hundred)).alias(f"e{k}") for k in range(n)])


def _wht_sql() -> str:
    def four(a, b, c, d):
        return f"({a}+{b}+{c}+{d})", f"({a}+{b}-{c}-{d})", f"({a}-{b}-{c}+{d})", f"({a}-{b}+{c}-{d})"

    rows = [four(*(f"e{4 * r + k}" for k in range(4))) for r in range(4)]
    cols = [four(*(rows[r][k] for r in range(4))) for k in range(4)]
    return ", ".join(f"{cols[k][r]} AS c{4 * r + k}" for r in range(4) for k in range(4))


@query(f"WITH q AS (SELECT vec_id, {_E16} FROM embeddings) SELECT vec_id, {_wht_sql()} FROM q")
def walsh_hadamard(spark, sf_dir):
    vec = entries(spark, sf_dir, 16)
    t = P.hadamard([F.col(f"e{k}") for k in range(16)])
    # the transform's order is (sum, a-d+b-c, sum of outer minus inner, a-d-b+c); given here by sign changes
    order = [0, 1, 2, 3]
    return vec.select("vec_id", *[t[4 * order[r] + order[k]].alias(f"c{4 * r + k}") for r in range(4) for k in range(4)])


# ---------------------------------------------------------------- options

_PRESET_ROWS = "('default', 50, 60, 0, 0, 4), ('picture', 80, 35, 4, 0, 4), ('photo', 80, 30, 3, 2, 4), ('drawing', 25, 10, 6, 0, 4), ('icon', 0, 0, 0, 0, 4), ('text', 0, 0, 0, 0, 2)"


@query(f"SELECT * FROM (VALUES {_PRESET_ROWS}) t(preset, sns_strength, filter_strength, filter_sharpness, preprocessing, segments)")
def preset_options(spark, sf_dir):
    rows = [(n, *(getattr(O.preset(n), c) for c in ("sns_strength", "filter_strength", "filter_sharpness", "preprocessing", "segments"))) for n in O.PRESETS]
    return spark.createDataFrame(rows, "preset string, sns_strength int, filter_strength int, filter_sharpness int, preprocessing int, segments int")


_BAD = [("quality", "event_id % 110 - 4", "v < 0 OR v > 100"), ("method", "event_id % 9 - 1", "v < 0 OR v > 6"), ("filter_sharpness", "event_id % 10 - 1", "v < 0 OR v > 7"), ("segments", "event_id % 7 - 1", "v > 4"), ("alpha_quality", "event_id * 3 % 113 - 5", "v > 100")]


@query("SELECT event_id, CASE " + " ".join(f"WHEN {c.replace('v', '(' + e + ')')} THEN '{n}'" for n, e, c in _BAD) + " END AS error, CAST(CASE WHEN event_id % 7 - 1 < 0 THEN 4 ELSE event_id % 7 - 1 END AS BIGINT) AS segments FROM events")
def option_validation(spark, sf_dir):
    values = {k: F.lit(v) for k, v in O.Options().row().items()} | {n: F.expr(e) for n, e, _ in _BAD}
    return table(spark, sf_dir, "events").select("event_id", O.first_error(values).alias("error"), O.resolved("segments", values["segments"]).cast("long").alias("segments"))


# ---------------------------------------------------------------- bitstreams

_TILES = """tl AS (SELECT p_partkey // 256 AS image_id, p_partkey % 256 // 16 AS y, p_partkey % 16 AS x, CAST(p_size * 5 % 256 AS INT) AS r, CAST(p_partkey * 7 % 256 AS INT) AS g, CAST((p_partkey // 16 * 3 + p_size) % 256 AS INT) AS b, CAST(CASE WHEN p_size % 7 = 0 THEN 0 ELSE 255 - p_size END AS INT) AS a FROM part)"""


def tiles(spark, sf_dir: str) -> DataFrame:
    """Images of 16 x 16 pixels of the parts."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select(
        F.floor(k / 256).alias("image_id"), F.floor(k % 256 / 16).alias("y"), (k % 16).alias("x"), i(s * 5 % 256).alias("r"), i(k * 7 % 256).alias("g"), i((F.floor(k / 16) * 3 + s) % 256).alias("b"),
        i(F.when(s % 7 == 0, 0).otherwise(255 - s)).alias("a"),
    )


_FULL = "cells AS (SELECT image_id, r.range // 16 AS y, r.range % 16 AS x FROM (SELECT DISTINCT image_id FROM tl) CROSS JOIN range(256) r)"


@query(f"""WITH {_TILES}, {_FULL} SELECT image_id, y, x, """ + ", ".join(f"coalesce(CASE WHEN a = 0 THEN 0 ELSE {c} END, 0) AS {c}" for c in "rgba") + " FROM cells LEFT JOIN tl USING (image_id, y, x)")
def lossless_roundtrip(spark, sf_dir):
    """Images encoded to lossless files and decoded again, as pixels."""
    from ..codec import columns as C

    images = C.images_of(tiles(spark, sf_dir), "image_id", 16, 16)
    return C.pixel_rows(C.decoded(C.encoded(images, "image_id"), "image_id"), "image_id")


@query(f"""WITH {_TILES}, {_FULL} SELECT image_id, y, x, coalesce(a, 0) AS a FROM cells LEFT JOIN tl USING (image_id, y, x)""")
def alpha_roundtrip(spark, sf_dir):
    """Alpha planes encoded, with the filter that suits them, and decoded again."""
    from ..codec import columns as C

    byte = tiles(spark, sf_dir).withColumns({c: F.col("a") for c in "rgb"})
    images = C.images_of(byte, "image_id", 16, 16)
    plane = images.select("image_id", "width", "height", F.expr("unhex(array_join(transform(sequence(0, width * height - 1), k -> hex(substring(data, k * 4 + 1, 1))), ''))").alias("data"))
    back = C.alpha_decoded(C.alpha_encoded(plane, "image_id").join(plane.select("image_id", "width", "height"), "image_id"), "image_id").select("image_id", F.hex("data").alias("h"))
    cells = back.select("image_id", "h", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("k"))
    return cells.select("image_id", F.floor(F.col("k") / 16).alias("y"), (F.col("k") % 16).cast("long").alias("x"), F.conv(F.substring(F.col("h"), F.col("k") * 2 + 1, F.lit(2)), 16, 10).cast("int").alias("a"))


@query(f"""WITH {_TILES} SELECT image_id, 16 AS width, 16 AS height, TRUE AS has_alpha, 'lossless' AS format, 1 AS frame_count FROM tl GROUP BY image_id""")
def probe_encoded(spark, sf_dir):
    from ..codec import columns as C
    from ..sources.tables import features

    images = C.images_of(tiles(spark, sf_dir), "image_id", 16, 16)
    return features(C.encoded(images, "image_id"), "image_id").select("image_id", "width", "height", "has_alpha", "format", "frame_count")


@query(f"""WITH {_TILES}, n AS (SELECT image_id // 8 AS anim_id, image_id % 8 AS frame, row_number() OVER (PARTITION BY image_id // 8 ORDER BY image_id) - 1 AS k FROM (SELECT DISTINCT image_id FROM tl))
SELECT anim_id, CAST(k AS INT) AS frame_idx, CAST(2 * frame AS INT) AS x, 0 AS y, 16 AS w, 16 AS h, 10 * frame AS duration_ms, CAST(frame % 2 AS INT) AS dispose, TRUE AS lossless FROM n""")
def animation_roundtrip(spark, sf_dir):
    """Eight images at a time as frames of an animation file, muxed and read back."""
    from ..codec import columns as C
    from ..operators.mux import animated
    from ..sources.tables import frames as frames_of

    images = C.encoded(C.images_of(tiles(spark, sf_dir), "image_id", 16, 16), "image_id")
    k = F.col("image_id") % 8
    frames_ = images.select(F.floor(F.col("image_id") / 8).alias("anim_id"), k.alias("frame_idx"), (2 * k).alias("x"), F.lit(0).alias("y"), F.lit(16).alias("w"), F.lit(16).alias("h"), (10 * k).alias("duration_ms"), (k % 2).alias("dispose"), F.lit(0).alias("no_blend"), B.tail(F.col("content"), F.lit(20)).alias("data"))
    return frames_of(animated(frames_), "anim_id").select("anim_id", "frame_idx", "x", "y", "w", "h", "duration_ms", "dispose", "lossless")


# ---------------------------------------------------------------- signal

_DENSE = "dn AS (SELECT c.y, c.x, CAST(coalesce(p_size * 5 % 256, 0) AS INT) AS a, CAST(coalesce((p_size * 5 + p_partkey % 23) % 256, 0) AS INT) AS b FROM (SELECT DISTINCT p_partkey // 32 AS y, r.range AS x FROM part CROSS JOIN range(32) r) c LEFT JOIN part ON p_partkey = c.y * 32 + c.x)"


def dense(spark, sf_dir: str) -> DataFrame:
    """Two planes of 32 columns, a value for each part, 0 where there is none."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    part = table(spark, sf_dir, "part")
    cells = part.select(F.floor(k / 32).alias("y")).distinct().withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))))
    values = part.select(F.floor(k / 32).alias("y"), (k % 32).alias("x"), i(s * 5 % 256).alias("a"), i((s * 5 + k % 23) % 256).alias("b"))
    zero = F.lit(0)
    return cells.join(values, ["y", "x"], "left").select("y", "x", F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b"))


@query(f"""WITH {_DENSE}, n AS (SELECT p.y, p.x, p.a, l.a AS l, r.a AS r, u.a AS u, d.a AS d FROM dn p LEFT JOIN dn l ON l.y = p.y AND l.x = p.x - 1 LEFT JOIN dn r ON r.y = p.y AND r.x = p.x + 1 LEFT JOIN dn u ON u.y = p.y - 1 AND u.x = p.x LEFT JOIN dn d ON d.y = p.y + 1 AND d.x = p.x)
SELECT y, x, CAST(CASE WHEN l IS NULL OR r IS NULL OR u IS NULL OR d IS NULL OR (abs(a - l) < 8 AND abs(a - r) < 8 AND abs(a - u) < 8 AND abs(a - d) < 8) THEN a WHEN a + 3 + ((a >> 3) & 1) > 255 THEN 255 ELSE ((a + 3 + ((a >> 3) & 1)) // 8) * 8 END AS INT) AS a FROM n""")
def near_lossless(spark, sf_dir):
    from ..operators.planes import near_lossless_pass

    return near_lossless_pass(dense(spark, sf_dir).select("y", "x", "a"), "a", 3)


_HAT = "h(d, w) AS (VALUES (-3, 1), (-2, 2), (-1, 3), (0, 4), (1, 3), (2, 2), (3, 1))"


@query(f"""WITH {_DENSE}, {_HAT}, w AS (SELECT p.y, p.x, sum(hx.w * hy.w) AS n, sum(hx.w * hy.w * q.a) AS xm, sum(hx.w * hy.w * q.b) AS ym, sum(hx.w * hy.w * q.a * q.a) AS xx, sum(hx.w * hy.w * q.a * q.b) AS xy, sum(hx.w * hy.w * q.b * q.b) AS yy
 FROM dn p CROSS JOIN h hx CROSS JOIN h hy JOIN dn q ON q.y = p.y + hy.d AND q.x = p.x + hx.d GROUP BY 1, 2),
s AS (SELECT y, x, CAST(n AS BIGINT) AS n, CAST(xm AS BIGINT) AS xm, CAST(ym AS BIGINT) AS ym, CAST(xx AS BIGINT) AS xx, CAST(xy AS BIGINT) AS xy, CAST(yy AS BIGINT) AS yy FROM w)
SELECT y, x, round(CASE WHEN xm * xm + ym * ym < 64 * n * n THEN 1.0 ELSE CAST((2 * xm * ym + 20 * n * n) * ((2 * greatest(xy * n - xm * ym, 0) + 60 * n * n) >> 8) AS DOUBLE) / CAST((xm * xm + ym * ym + 20 * n * n) * ((xx * n - xm * xm + yy * n - ym * ym + 60 * n * n) >> 8) AS DOUBLE) END, 6) AS ssim FROM s""")
def ssim_windows(spark, sf_dir):
    from ..operators.planes import structural_similarity

    return structural_similarity(dense(spark, sf_dir), "a", "b").withColumn("ssim", F.round("ssim", 6))


@query(f"""WITH {_DENSE}, o(dy, dx) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1))
SELECT 2 * p.y + dy AS y, 2 * p.x + dx AS x, CAST((9 * p.a + 3 * coalesce(h.a, p.a) + 3 * coalesce(v.a, p.a) + CASE WHEN v.a IS NULL THEN coalesce(h.a, p.a) ELSE coalesce(dg.a, v.a) END + 8) >> 4 AS INT) AS v
FROM dn p CROSS JOIN o LEFT JOIN dn h ON h.y = p.y AND h.x = p.x + 2 * dx - 1 LEFT JOIN dn v ON v.y = p.y + 2 * dy - 1 AND v.x = p.x LEFT JOIN dn dg ON dg.y = p.y + 2 * dy - 1 AND dg.x = p.x + 2 * dx - 1""")
def chroma_upsampled(spark, sf_dir):
    from ..operators.planes import upsampled

    return upsampled(dense(spark, sf_dir).select("y", "x", "a"), "a")


_E32 = ", ".join(f"CAST(floor(embedding[{k + 1}] * 100) AS INT) AS e{k}" for k in range(32))


def _dct_sql() -> str:
    """The forward transform as nested selects."""
    e = [f"e{k}" for k in range(16)]
    rows, out = [], []
    for k in range(4):
        a, b, c, d = e[4 * k : 4 * k + 4]
        p, q, r, s = f"({a}+{d})", f"({b}+{c})", f"({b}-{c})", f"({a}-{d})"
        rows += [f"({p}+{q})*8 AS m{4 * k}", f"({r}*2217+{s}*5352+1812)>>9 AS m{4 * k + 1}", f"({p}-{q})*8 AS m{4 * k + 2}", f"({s}*2217-{r}*5352+937)>>9 AS m{4 * k + 3}"]
    for k in range(4):
        a, b, c, d = (f"m{k + 4 * r}" for r in range(4))
        p, q, r, s = f"({a}+{d})", f"({b}+{c})", f"({b}-{c})", f"({a}-{d})"
        out += [(k, f"({p}+{q}+7)>>4"), (4 + k, f"(({r}*2217+{s}*5352+12000)>>16)+CASE WHEN {s}<>0 THEN 1 ELSE 0 END"), (8 + k, f"({p}-{q}+7)>>4"), (12 + k, f"({s}*2217-{r}*5352+51000)>>16")]
    return f"SELECT vec_id, {', '.join(f'CAST({x} AS INT) AS c{n}' for n, x in sorted(out))} FROM (SELECT vec_id, {', '.join(rows)} FROM q)"


@query(f"WITH q AS (SELECT vec_id, {_E16} FROM embeddings) {_dct_sql()}")
def block_dct(spark, sf_dir):
    vec = entries(spark, sf_dir, 16)
    return vec.select("vec_id", *[i(c).alias(f"c{k}") for k, c in enumerate(P.forward_dct([F.col(f"e{k}") for k in range(16)]))])


@query(f"WITH q AS (SELECT vec_id, {_E16} FROM embeddings) SELECT vec_id, TRUE AS near FROM q")
def dct_roundtrip(spark, sf_dir):
    """The inverse transform of the forward one gives each difference back to within 1. A vector of fewer values has none to differ."""
    vec = entries(spark, sf_dir, 16)
    vec = vec.select("*", *[c.alias(f"c{k}") for k, c in enumerate(P.forward_dct([F.col(f"e{k}") for k in range(16)]))])
    back = P.inverse_dct([F.col(f"c{k}") for k in range(16)])
    return vec.select("vec_id", F.greatest(*[F.abs(b - F.col(f"e{k}")) for k, b in enumerate(back)]).alias("d")).select("vec_id", F.coalesce(F.col("d") <= 1, F.lit(True)).alias("near"))


_TEXTURE = (38, 32, 20, 9, 32, 28, 17, 7, 20, 17, 10, 4, 9, 7, 4, 2)


def _texture_sql(first: int) -> str:
    def four(a, b, c, d):
        p, q, r, s = f"({a}+{c})", f"({b}+{d})", f"({b}-{d})", f"({a}-{c})"
        return f"({p}+{q})", f"({s}+{r})", f"({s}-{r})", f"({p}-{q})"

    rows = [four(*(f"e{first + 4 * k + j}" for j in range(4))) for k in range(4)]
    cols = [four(*(rows[r][k] for r in range(4))) for k in range(4)]
    return "(" + " + ".join(f"{_TEXTURE[4 * r + k]}*abs({cols[k][r]})" for r in range(4) for k in range(4)) + ")"


@query(f"WITH q AS (SELECT vec_id, {_E32} FROM embeddings) SELECT vec_id, CAST(abs({_texture_sql(16)} - {_texture_sql(0)}) >> 5 AS INT) AS distortion FROM q")
def texture_distortion(spark, sf_dir):
    vec = entries(spark, sf_dir, 32)
    e = [F.col(f"e{k}") for k in range(32)]
    return vec.select("vec_id", i(P.texture_distortion(e[:16], e[16:])).alias("distortion"))
