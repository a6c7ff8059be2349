"""More queries, over images derived from the driver's tables and over hand-built files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import pixels as P
from .cases import CASES
from .queries import PIXEL_SQL, i, pixels, query, table

_WALK = "walk(name, error, n_frames, width, height, has_alpha, alpha_frames, empty_frames, loop_count)"

# What either walk makes of each file, from the format's rules.
_STRICT = """
 ('lossy', NULL, 1, 16, 8, FALSE, 0, 0, 0),
 ('lossy_no_key_frame', 'not a key frame', 0, 0, 0, FALSE, 0, 0, 0),
 ('lossy_no_width', 'zero size', 0, 0, 0, FALSE, 0, 0, 0),
 ('lossless_alpha', NULL, 1, 3, 5, TRUE, 1, 0, 0),
 ('lossless_version', 'bad version', 0, 0, 0, FALSE, 0, 0, 0),
 ('lossless_short', 'truncated', 0, 0, 0, FALSE, 0, 0, 0),
 ('lossless_no_pad', 'truncated chunk', 0, 0, 0, FALSE, 0, 0, 0),
 ('chunk_cut', 'truncated chunk', 0, 0, 0, FALSE, 0, 0, 0),
 ('chunk_unknown', 'unknown chunk', 0, 0, 0, FALSE, 0, 0, 0),
 ('still_alpha', NULL, 1, 16, 8, TRUE, 1, 0, 1),
 ('still_alpha_lossless', 'alpha beside a lossless image', 0, 10, 20, TRUE, 0, 0, 1),
 ('still_alpha_only', 'alpha without image', 0, 10, 20, TRUE, 0, 0, 1),
 ('still_alpha_apart', 'alpha without image', 0, 10, 20, TRUE, 0, 0, 1),
 ('still_nothing', NULL, 0, 10, 20, FALSE, 0, 0, 1),
 ('still_bad_image', 'bad signature', 0, 10, 20, FALSE, 0, 0, 1),
 ('header_flags', 'unknown flags', 0, 0, 0, FALSE, 0, 0, 0),
 ('header_reserved', NULL, 1, 3, 5, FALSE, 0, 0, 1),
 ('header_long', 'bad extended header', 0, 0, 0, FALSE, 0, 0, 0),
 ('header_twice', 'second extended header', 0, 10, 20, FALSE, 0, 0, 1),
 ('canvas_area', 'canvas too large', 0, 32768, 32768, FALSE, 0, 0, 0),
 ('frames', NULL, 2, 10, 20, FALSE, 1, 0, 3),
 ('frames_short_anim', 'bad animation chunk', 0, 10, 20, FALSE, 0, 0, 1),
 ('frames_no_anim', 'frame before animation chunk', 0, 10, 20, FALSE, 0, 0, 1),
 ('frames_no_flag', 'image chunk in an animation', 1, 10, 20, FALSE, 0, 0, 3),
 ('frames_image_outside', 'image chunk in an animation', 1, 10, 20, FALSE, 0, 0, 3),
 ('frame_short', 'truncated frame', 0, 10, 20, FALSE, 0, 0, 3),
 ('frame_empty', NULL, 2, 10, 20, FALSE, 0, 1, 3),
 ('frame_alpha_only', 'alpha without image', 0, 10, 20, FALSE, 0, 0, 3),
 ('frame_bad_image', 'bad signature', 0, 10, 20, FALSE, 0, 0, 3),
 ('frame_two_images', NULL, 1, 10, 20, FALSE, 1, 0, 3),
 ('frame_other_size', NULL, 1, 10, 20, FALSE, 0, 0, 3),
 ('frame_area', 'frame too large', 0, 10, 20, FALSE, 0, 0, 3),
 ('frame_cut_chunk', 'truncated chunk', 0, 10, 20, FALSE, 0, 0, 3)"""
_LENIENT = """
 ('lossy', NULL, 1, 16, 8, FALSE, 0, 0, 0),
 ('lossy_no_key_frame', NULL, 1, 16, 8, FALSE, 0, 0, 0),
 ('lossy_no_width', NULL, 1, 0, 8, FALSE, 0, 0, 0),
 ('lossless_alpha', NULL, 1, 3, 5, TRUE, 1, 0, 0),
 ('lossless_version', NULL, 1, 3, 5, FALSE, 0, 0, 0),
 ('lossless_short', 'truncated', 0, 0, 0, FALSE, 0, 0, 0),
 ('lossless_no_pad', NULL, 1, 3, 5, FALSE, 0, 0, 0),
 ('chunk_cut', 'truncated chunk', 0, 0, 0, FALSE, 0, 0, 0),
 ('chunk_unknown', 'unknown chunk', 0, 0, 0, FALSE, 0, 0, 0),
 ('still_alpha', NULL, 1, 10, 20, TRUE, 1, 0, 0),
 ('still_alpha_lossless', NULL, 1, 10, 20, TRUE, 1, 0, 0),
 ('still_alpha_only', 'no image', 0, 10, 20, TRUE, 0, 0, 0),
 ('still_alpha_apart', NULL, 1, 10, 20, TRUE, 1, 0, 0),
 ('still_nothing', 'no image', 0, 10, 20, FALSE, 0, 0, 0),
 ('still_bad_image', NULL, 1, 10, 20, FALSE, 0, 0, 0),
 ('header_flags', NULL, 1, 10, 20, FALSE, 0, 0, 0),
 ('header_reserved', NULL, 1, 10, 20, FALSE, 0, 0, 0),
 ('header_long', NULL, 1, 10, 20, FALSE, 0, 0, 0),
 ('header_twice', NULL, 1, 10, 20, FALSE, 0, 0, 0),
 ('canvas_area', NULL, 1, 32768, 32768, FALSE, 0, 0, 0),
 ('frames', NULL, 2, 10, 20, FALSE, 1, 0, 3),
 ('frames_short_anim', 'bad animation chunk', 0, 10, 20, FALSE, 0, 0, 0),
 ('frames_no_anim', NULL, 1, 10, 20, FALSE, 0, 0, 0),
 ('frames_no_flag', NULL, 1, 10, 20, FALSE, 0, 0, 3),
 ('frames_image_outside', NULL, 1, 10, 20, FALSE, 0, 0, 3),
 ('frame_short', 'truncated frame', 0, 10, 20, FALSE, 0, 0, 3),
 ('frame_empty', NULL, 2, 10, 20, FALSE, 0, 1, 3),
 ('frame_alpha_only', NULL, 2, 10, 20, FALSE, 1, 1, 3),
 ('frame_bad_image', NULL, 2, 10, 20, FALSE, 0, 0, 3),
 ('frame_two_images', NULL, 1, 10, 20, FALSE, 0, 0, 3),
 ('frame_other_size', NULL, 1, 10, 20, FALSE, 0, 0, 3),
 ('frame_area', 'frame too large', 0, 10, 20, FALSE, 0, 0, 3),
 ('frame_cut_chunk', NULL, 2, 10, 20, FALSE, 0, 1, 3)"""


def _walked(spark, mode: str) -> DataFrame:
    from ..sources.tables import features, frames

    files = spark.createDataFrame([(n, bytearray(c)) for n, c in CASES.items()], "name string, content binary")
    seen = frames(files, "name", mode).groupBy("name").agg(F.count(F.when(F.col("has_alpha"), 1)).alias("alpha_frames"), F.count(F.when(F.col("data").isNull() & F.col("error").isNull(), 1)).alias("empty_frames"))
    zero = F.lit(0).cast("long")
    return features(files, "name", mode).join(seen, "name", "left").select("name", "error", F.col("frame_count").alias("n_frames"), "width", "height", "has_alpha", F.coalesce("alpha_frames", zero).alias("alpha_frames"), F.coalesce("empty_frames", zero).alias("empty_frames"), "loop_count")


@query(f"SELECT * FROM (VALUES {_STRICT}) {_WALK}")
def strict_walk(spark, sf_dir):
    return _walked(spark, "strict")


@query(f"SELECT * FROM (VALUES {_LENIENT}) {_WALK}")
def lenient_walk(spark, sf_dir):
    return _walked(spark, "lenient")


@query("""WITH c AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'EXIF' WHEN 'user' THEN 'XMP ' ELSE 'ICCP' END AS fourcc, text FROM conversations)
SELECT conv_id, 'strict' AS mode, fourcc, arg_min(text, turn) AS text FROM c GROUP BY ALL UNION ALL SELECT conv_id, 'lenient', fourcc, arg_max(text, turn) FROM c GROUP BY ALL""")
def metadata_lookup(spark, sf_dir):
    """Files with the turns of each conversation as metadata chunks: the first of a kind counts strictly, the last leniently."""
    from ..sources.tables import metadata

    tag = F.when(F.col("role") == "system", "EXIF").when(F.col("role") == "user", "XMP ").otherwise("ICCP")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.hex(B.chunk(tag, F.col("text").cast("binary"))).alias("c"))
    body = turns.groupBy("conv_id").agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "c"))), lambda s: s["c"]), "")).alias("body"))
    head = B.chunk("VP8X", B.extended_header_bytes(F.lit(B.FLAGS["icc"] + B.FLAGS["exif"] + B.FLAGS["xmp"]), F.lit(1), F.lit(1)))
    image = B.chunk("VP8L", B.lossless_header_bytes(F.lit(1), F.lit(1), F.lit(0)))
    files = body.select("conv_id", B.riff(head, F.col("body"), image).alias("content"))
    both = [metadata(files, "ICCP", "EXIF", "XMP ", key="conv_id", mode=m).withColumn("mode", F.lit(m)) for m in ("strict", "lenient")]
    return both[0].unionByName(both[1]).select("conv_id", "mode", "fourcc", F.col("data").cast("string").alias("text"))


# ---------------------------------------------------------------- whole images

_PHOTO = """ph AS (SELECT event_id // 4096 AS image_id, event_id % 4096 // 64 AS y, event_id % 64 AS x, CAST((event_id % 64 * 3 + event_id % 4096 // 64 * 2 + event_id * 31 % 7) % 256 AS INT) AS r,
 CAST((event_id % 4096 // 64 * 4 + event_id % 64) % 256 AS INT) AS g, CAST((event_id % 64 * event_id % 97 + 40) % 256 AS INT) AS b, CAST(CASE WHEN event_id % 11 = 0 THEN 255 - event_id % 4 ELSE 255 END AS INT) AS a FROM events)"""


def photos(spark, sf_dir: str) -> DataFrame:
    """Images of 64 x 64 pixels of the events, with gradients, noise and thousands of colours."""
    k = F.col("event_id")
    y, x = F.floor(k % 4096 / 64), k % 64
    return table(spark, sf_dir, "events").select(
        F.floor(k / 4096).alias("image_id"), y.alias("y"), x.alias("x"), i((x * 3 + y * 2 + k * 31 % 7) % 256).alias("r"), i((y * 4 + x) % 256).alias("g"), i((x * k % 97 + 40) % 256).alias("b"),
        i(F.when(k % 11 == 0, 255 - k % 4).otherwise(255)).alias("a"),
    )


def _cells(name: str, side: int) -> str:
    return f"cells AS (SELECT image_id, r.range // {side} AS y, r.range % {side} AS x FROM (SELECT DISTINCT image_id FROM {name}) CROSS JOIN range({side * side}) r)"


@query(f"""WITH {_PHOTO}, {_cells('ph', 64)} SELECT image_id, y, x, """ + ", ".join(f"coalesce({c}, 0) AS {c}" for c in "rgba") + " FROM cells LEFT JOIN ph USING (image_id, y, x)")
def lossless_photo_roundtrip(spark, sf_dir):
    """Images of too many colours for a palette: predictors, cross-colour and green transforms, colour cache, distant matches."""
    from ..codec import columns as C

    images = C.images_of(photos(spark, sf_dir), "image_id", 64, 64)
    return C.pixel_rows(C.decoded(C.encoded(images, "image_id"), "image_id"), "image_id")


_LAYER = """ly AS (SELECT image_id // 8 AS anim_id, image_id % 8 AS k, image_id, y, x, r, g, b, CASE WHEN a = 0 THEN 0 ELSE 255 END AS a FROM (
 SELECT p_partkey // 256 AS image_id, p_partkey % 256 // 16 AS y, p_partkey % 16 AS x, CAST(p_size * 5 % 256 AS INT) AS r, CAST(p_partkey * 7 % 256 AS INT) AS g, CAST((p_partkey // 16 * 3 + p_size) % 256 AS INT) AS b, CASE WHEN p_size % 7 = 0 THEN 0 ELSE 1 END AS a FROM part))"""


@query(f"""WITH {_LAYER}, {_cells('ly', 16).replace('DISTINCT image_id', 'DISTINCT anim_id, k, image_id').replace('SELECT image_id,', 'SELECT anim_id, k, image_id,')},
full_ AS (SELECT c.anim_id, c.k, c.y, c.x + 2 * c.k AS x, coalesce(l.a, 0) AS a, """ + ", ".join(f"CASE WHEN coalesce(l.a, 0) = 0 THEN 0 ELSE l.{c} END AS {c}" for c in "rgb") + """ FROM cells c LEFT JOIN ly l USING (image_id, y, x)),
n AS (SELECT anim_id, max(k) AS last FROM ly GROUP BY anim_id), cv AS (SELECT anim_id, last, r.range // 32 AS y, r.range % 32 AS x FROM n CROSS JOIN range(512) r)
SELECT cv.anim_id, cv.y, cv.x, """ + ", ".join(f"CAST(coalesce(arg_max(f.{c}, f.k) FILTER (f.a <> 0 OR f.k % 2 = 1), 0) AS INT) AS {c}" for c in "rgba") + " FROM cv LEFT JOIN full_ f ON f.anim_id = cv.anim_id AND f.y = cv.y AND f.x = cv.x GROUP BY 1, 2, 3")
def animation_canvases(spark, sf_dir):
    """Images encoded as frames, muxed eight to a file, read back, decoded and composed: the last canvas of each animation."""
    from ..codec import columns as C
    from ..operators.animation import canvases
    from ..operators.mux import animated
    from ..sources.tables import frames
    from .queries import tiles

    px = tiles(spark, sf_dir).withColumn("a", F.when(F.col("a") == 0, 0).otherwise(255))
    images = C.encoded(C.images_of(px, "image_id", 16, 16), "image_id")
    k, n = F.col("image_id") % 8, F.lit
    rows = images.select(F.floor(F.col("image_id") / 8).alias("anim_id"), k.alias("frame_idx"), (2 * k).alias("x"), n(0).alias("y"), n(16).alias("w"), n(16).alias("h"), n(40).alias("duration_ms"), n(0).alias("dispose"), (k % 2).alias("no_blend"), B.tail(F.col("content"), F.lit(20)).alias("data"))
    shown = canvases(C.frames_decoded(frames(animated(rows, canvas=(32, 16)), "anim_id")).withColumn("no_blend", F.col("no_blend") == 1), 32, 16)
    last = shown.groupBy("anim_id").agg(F.max_by(F.struct("width", "height", "data"), "frame_idx").alias("s")).select("anim_id", "s.*")
    return C.pixel_rows(last, "anim_id")


@query("""SELECT CAST(l.doc_id AS BIGINT) AS doc_id, CASE WHEN l.doc_id % 5 = 0 THEN 'frame outside the canvas' END AS error, CASE WHEN l.doc_id % 5 <> 0 THEN 100 END AS width, CASE WHEN l.doc_id % 5 <> 0 THEN 60 END AS height,
 CASE WHEN l.doc_id % 5 <> 0 THEN 2 END AS n_frames, CASE WHEN l.doc_id % 5 <> 0 AND l.doc_id % 3 = 0 THEN 'icc ' || l.doc_id END AS icc, CASE WHEN l.doc_id % 5 <> 0 AND l.doc_id % 2 = 0 THEN 'xmp ' || l.doc_id END AS xmp FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id IS NOT NULL) l""")
def muxed_metadata(spark, sf_dir):
    """Animations with an explicit canvas, which some frames don't fit, and with metadata, read back."""
    from ..operators.mux import animated
    from ..sources.tables import features, metadata

    d = F.col("doc_id")
    ids = table(spark, sf_dir, "labels").where("doc_id is not null").select("doc_id").distinct()
    rows = ids.select(d.alias("anim_id"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("frame_idx")).select("anim_id", "frame_idx", (F.col("frame_idx") * F.when(F.col("anim_id") % 5 == 0, 98).otherwise(90)).alias("x"), F.lit(0).alias("y"), F.lit(10).alias("w"), F.lit(20).alias("h"), F.lit(10).alias("duration_ms"), F.lit(0).alias("dispose"), F.lit(0).alias("no_blend"), B.lossless_header_bytes(F.lit(10), F.lit(20), F.lit(0)).alias("data"))
    text = lambda n, k: F.when(d % k == 0, F.concat(F.lit(n + " "), d.cast("string"))).cast("binary")
    given = ids.select(d.alias("anim_id"), text("icc", 3).alias("icc"), F.lit(None).cast("binary").alias("exif"), text("xmp", 2).alias("xmp"))
    files = animated(rows, canvas=(100, 60), metadata=given)
    good = files.where("error is null").select("anim_id", "content")
    found = metadata(good, "ICCP", "XMP ", key="anim_id").groupBy("anim_id").pivot("fourcc", ["ICCP", "XMP "]).agg(F.first("data"))
    read = features(good, "anim_id").select("anim_id", "width", "height", F.col("frame_count").alias("n_frames"))
    out = files.select("anim_id", "error").join(read, "anim_id", "left").join(found, "anim_id", "left")
    return out.select(F.col("anim_id").alias("doc_id"), "error", "width", "height", "n_frames", F.col("ICCP").cast("string").alias("icc"), F.col("XMP ").cast("string").alias("xmp"))


def stand_in_tables():
    """Probability tables by rule, for queries and tests: the format's own are a parameter. Chances of zero rise with the place."""
    from ..codec.lossy import Tables

    coefficients = [[[[min(255, 60 + 25 * c + 12 * band + 7 * k) for k in range(11)] for c in range(3)] for band in range(8)] for _ in range(4)]
    return Tables(coefficients, [[[[255] * 11] * 3] * 8] * 4, [[[128] * 9] * 10] * 10)


@query(f"""WITH {_PHOTO} SELECT image_id, 64 AS width, 64 AS height, TRUE AS has_alpha, 'extended' AS format, TRUE AS near FROM ph GROUP BY image_id""")
def lossy_photo_roundtrip(spark, sf_dir):
    """Lossy files of gradients (blue and alpha without noise) at quality 75: header fields, and 25 dB and at most 80 off for each
    channel; alpha comes back exactly."""
    from ..codec import columns as C
    from ..sources.tables import features

    tables = stand_in_tables()
    px = photos(spark, sf_dir).withColumns({"r": i(F.col("x") * 255 / 64), "g": i(F.col("y") * 255 / 64), "b": i((F.col("x") + F.col("y")) * 255 / 128), "a": i(255 - F.col("y") % 2)})
    images = C.images_of(px, "image_id", 64, 64)
    files = C.encoded(images, "image_id", 75.0, tables)
    head = features(files, "image_id").select("image_id", "width", "height", "has_alpha", "format")
    back = C.pixel_rows(C.decoded(files, "image_id", tables), "image_id").alias("b")
    both = back.join(px.alias("p"), ["image_id", "y", "x"])
    d = {c: F.col(f"p.{c}") - F.col(f"b.{c}") for c in "rgba"}
    per = [(F.avg(d[c] * d[c]) <= 65025 / 10**2.5) & (F.max(F.abs(d[c])) <= 80) for c in "rgb"]
    near = both.groupBy("image_id").agg((per[0] & per[1] & per[2] & (F.max(F.abs(d["a"])) == 0)).alias("near"))
    return head.join(near, "image_id")


# ---------------------------------------------------------------- planes

_WIDE = "wd AS (SELECT p_partkey // 32 AS y, p_partkey % 32 AS x, CAST(p_size * 5 % 256 AS INT) AS r, CAST(p_partkey * 7 % 256 AS INT) AS g, CAST((p_size + p_partkey) % 256 AS INT) AS b, CAST(CASE WHEN (p_partkey % 32 // 8 + p_partkey // 256) % 3 <> 0 OR p_size % 5 = 0 THEN 0 ELSE 255 END AS INT) AS a FROM part)"


@query(f"""WITH {_WIDE}, h AS (SELECT max(y) + 1 AS height FROM wd), bl AS (SELECT y // 8 AS y8, x // 8 AS x8, max(a) AS most, arg_min(r, y * 100 + x) AS fr, arg_min(g, y * 100 + x) AS fg, arg_min(b, y * 100 + x) AS fb,
 """ + ", ".join(f"sum({c}) FILTER (a <> 0) // count(*) FILTER (a <> 0) AS m{c}" for c in "rgb") + """ FROM wd GROUP BY 1, 2),
cl AS (SELECT *, x8 - row_number() OVER (PARTITION BY y8 ORDER BY x8) AS run FROM bl CROSS JOIN h WHERE most = 0 AND (y8 + 1) * 8 <= height),
ca AS (SELECT y8, x8, """ + ", ".join(f"first_value(f{c}) OVER (PARTITION BY y8, run ORDER BY x8) AS c{c}" for c in "rgb") + """ FROM cl)
SELECT y, x, """ + ", ".join(f"CAST(CASE WHEN ca.y8 IS NOT NULL THEN c{c} WHEN a = 0 AND m{c} IS NOT NULL THEN m{c} ELSE {c} END AS INT) AS {c}" for c in "rgb") + ", a FROM wd JOIN bl ON bl.y8 = y // 8 AND bl.x8 = x // 8 LEFT JOIN ca ON ca.y8 = y // 8 AND ca.x8 = x // 8")
def transparent_carried(spark, sf_dir):
    """Clearing before lossy encoding: means inside blocks, and one colour along runs of wholly transparent blocks."""
    from ..operators.planes import smoothed

    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    clear = ((F.floor(k % 32 / 8) + F.floor(k / 256)) % 3 != 0) | (s % 5 == 0)
    px = table(spark, sf_dir, "part").select(F.floor(k / 32).alias("y"), (k % 32).alias("x"), i(s * 5 % 256).alias("r"), i(k * 7 % 256).alias("g"), i((s + k) % 256).alias("b"), i(F.when(clear, 0).otherwise(255)).alias("a"))
    return smoothed(px, 8, 32, px.agg(F.max("y")).first()[0] + 1)


def _near_pass(source: str, bits: int) -> str:
    half, size = (1 << bits) // 2 - 1 + (bits == 0), 1 << bits
    sides = " ".join(f"LEFT JOIN {source} {n} ON {n}.y = p.y + {dy} AND {n}.x = p.x + {dx}" for n, dy, dx in (("l", 0, -1), ("r", 0, 1), ("u", -1, 0), ("d", 1, 0)))
    smooth = " AND ".join(f"abs(p.a - {n}.a) < {size}" for n in "lrud")
    return f"(SELECT p.y, p.x, CAST(CASE WHEN l.a IS NULL OR r.a IS NULL OR u.a IS NULL OR d.a IS NULL OR ({smooth}) THEN p.a WHEN p.a + {half} + ((p.a >> {bits}) & 1) > 255 THEN 255 ELSE ((p.a + {half} + ((p.a >> {bits}) & 1)) // {size}) * {size} END AS INT) AS a FROM {source} p {sides})"


@query(f"WITH n0 AS (SELECT p_partkey // 64 AS y, p_partkey % 64 AS x, CAST(p_size * 5 % 256 AS INT) AS a FROM part), n1 AS {_near_pass('n0', 2)}, n2 AS {_near_pass('n1', 1)} SELECT * FROM n2")
def near_lossless_quality(spark, sf_dir):
    """Quality 60: a pass of two bits, then one of one bit."""
    from ..operators.planes import near_lossless

    k = F.col("p_partkey")
    px = table(spark, sf_dir, "part").select(F.floor(k / 64).alias("y"), (k % 64).alias("x"), i(F.col("p_size").cast("long") * 5 % 256).alias("a"))
    return near_lossless(px, "a", 64, 64, 60)


_CENTRES = "[" + ", ".join(f"CASE WHEN n{k} > 0 THEN (t{k} + n{k} // 2) // greatest(n{k}, 1) ELSE c[{k + 1}] END" for k in range(4)) + "]"
_PLACE = "(CASE WHEN 2 * h.v > c[1] + c[2] THEN 1 ELSE 0 END + CASE WHEN 2 * h.v > c[2] + c[3] THEN 1 ELSE 0 END + CASE WHEN 2 * h.v > c[3] + c[4] THEN 1 ELSE 0 END)"


@query(f"""WITH RECURSIVE h AS (SELECT p_brand, CAST(p_size * 5 % 256 AS BIGINT) AS v, count(*) AS n FROM part GROUP BY ALL),
r(p_brand, k, before, c, moved) AS (SELECT p_brand, 0, [CAST(0 AS BIGINT)], [min(v) + (max(v) - min(v)) // 8, min(v) + 3 * (max(v) - min(v)) // 8, min(v) + 5 * (max(v) - min(v)) // 8, min(v) + 7 * (max(v) - min(v)) // 8], CAST(99 AS BIGINT) FROM h GROUP BY p_brand
 UNION ALL SELECT p_brand, k + 1, c, after, list_sum(list_transform(range(4), lambda j: abs(after[j + 1] - c[j + 1]))) FROM (SELECT p_brand, k, c, {_CENTRES} AS after FROM (
  SELECT r.p_brand, r.k, r.c, {', '.join(f'CAST(coalesce(sum(h.n) FILTER ({_PLACE} = {s}), 0) AS BIGINT) AS n{s}, CAST(coalesce(sum(h.v * h.n) FILTER ({_PLACE} = {s}), 0) AS BIGINT) AS t{s}' for s in range(4))}
  FROM r JOIN h ON h.p_brand = r.p_brand WHERE r.k < 6 AND r.moved >= 5 GROUP BY r.p_brand, r.k, r.c))),
f AS (SELECT p_brand, arg_max(before, k) AS c, arg_max(c, k) AS after FROM r GROUP BY p_brand)
SELECT h.p_brand, CAST(h.v AS INT) AS alpha, CAST({_PLACE} AS INT) AS segment, CAST(after[{_PLACE} + 1] AS INT) AS centre FROM h JOIN f USING (p_brand)""")
def segment_centres(spark, sf_dir):
    """k-means of the parts' values, brand by brand."""
    from ..operators.planes import segment_centres as centres

    return centres(table(spark, sf_dir, "part").select("p_brand", i(F.col("p_size") * 5 % 256).alias("alpha")), "p_brand", "alpha")


# ---------------------------------------------------------------- colour

_BENT_TO = "CASE WHEN {v} < {slope} * {end} THEN {v} / {slope} ELSE pow(({v} + {scale} - 1) / {scale}, 1 / {e}) END"
_BENT_FROM = "CASE WHEN {v} < {end} THEN {v} * {slope} ELSE {scale} * pow({v}, {e}) - ({scale} - 1) END"
_709 = {"end": "0.018053968510807e0", "slope": "4.5e0", "scale": "1.09929682680944e0", "e": "0.45e0"}
_240 = {"end": "0.022821585529445e0", "slope": "4e0", "scale": "1.111572195921731e0", "e": "0.45e0"}
_RGB = {"end": "0.0030412825601275209e0", "slope": "12.92e0", "scale": "1.0550107189475866e0", "e": "(1 / 2.4e0)"}


def _transfer_sql(back: bool) -> str:
    bent = _BENT_FROM if back else _BENT_TO
    v709, v240, vrgb = (f"least({bent.format(v='v', **c)}, {most})" for c, most in ((_709, "1e0"), (_240, "1e0"), (_RGB, "9e9")))
    curves = {n: v709 for n in ("bt709", "bt601", "bt2020_10", "bt2020_12", "bt1361")}
    curves |= {"iec61966": bent.format(v="v", **_709), "smpte240": v240, "srgb": vrgb, "linear": "v"}
    if back:
        curves |= {
            "bt470m": "pow(v, 1 / 2.2e0)", "bt470bg": "pow(v, 1 / 2.8e0)", "log100": "CASE WHEN v < 0.01e0 THEN 0 ELSE 1 + log10(v) / 2 END", "log100sqrt": "CASE WHEN v < 0.00316227766e0 THEN 0 ELSE 1 + log10(v) / 2.5e0 END",
            "pq": "CASE WHEN v > 0 THEN pow((107 / 128e0 + 2413 / 128e0 * pow(v, 653 / 4096e0)) / (1 + 2392 / 128e0 * pow(v, 653 / 4096e0)), 2523 / 32e0) ELSE 0 END",
            "smpte428": "pow(0.91655527974030934e0 * v, 1 / 2.6e0)", "hlg": "CASE WHEN pow(v, 1 / 1.2e0) <= 1 / 12e0 THEN sqrt(3 * pow(v, 1 / 1.2e0)) ELSE 0.17883277e0 * ln(12 * pow(v, 1 / 1.2e0) - 0.28466892e0) + 0.55991073e0 END",
        }
    else:
        curves |= {
            "bt470m": "pow(v, 2.2e0)", "bt470bg": "pow(v, 2.8e0)", "log100": "CASE WHEN v <= 0 THEN 0.005e0 ELSE pow(10, 2 * (v - 1)) END", "log100sqrt": "CASE WHEN v <= 0 THEN 0.00316227766e0 / 2 ELSE pow(10, 2.5e0 * (v - 1)) END",
            "pq": "CASE WHEN v > 0 THEN pow(greatest(pow(v, 32 / 2523e0) - 107 / 128e0, 0) / (2413 / 128e0 - 2392 / 128e0 * pow(v, 32 / 2523e0)), 4096 / 653e0) ELSE 0 END",
            "smpte428": "pow(v, 2.6e0) / 0.91655527974030934e0", "hlg": "CASE WHEN v <= 0.5e0 THEN pow(v * v / 3, 1.2e0) ELSE pow((exp((v - 0.55991073e0) / 0.17883277e0) + 0.28466892e0) / 12, 1.2e0) END",
        }
    return "CASE transfer " + " ".join(f"WHEN '{n}' THEN {e}" for n, e in curves.items()) + " END"


_LEVELS = "l AS (SELECT DISTINCT CAST(l_partkey % 256 AS INT) AS level FROM lineitem), t(transfer) AS (VALUES " + ", ".join(f"('{n}')" for n in "bt709 bt601 bt2020_10 bt2020_12 bt470m bt470bg smpte240 linear log100 log100sqrt iec61966 bt1361 srgb pq smpte428 hlg".split()) + ")"


@query(f"WITH {_LEVELS} SELECT level, transfer, round({_transfer_sql(False)}, 6) AS light, round({_transfer_sql(True)}, 6) AS signal FROM (SELECT level, transfer, level / 255e0 AS v FROM l CROSS JOIN t)")
def transfer_functions(spark, sf_dir):
    """Every transfer function both ways, for the levels that occur."""
    v = F.col("level") / 255.0
    both = F.array(*[F.struct(F.lit(t).alias("transfer"), F.round(P.to_linear(v, t), 6).alias("light"), F.round(P.from_linear(v, t), 6).alias("signal")) for t in P.TRANSFERS])
    return table(spark, sf_dir, "lineitem").select(i(F.col("l_partkey") % 256).alias("level")).distinct().select("level", F.explode(both).alias("s")).select("level", "s.*")


@query("""WITH w AS (SELECT n_nationkey, 0.2 + n_nationkey % 5 * 0.03e0 AS kr, 0.05 + n_nationkey % 7 * 0.01e0 AS kb FROM nation), m AS (SELECT *, 1e0 - kr - kb AS kg, 0.5e0 / (1e0 - kb) * (224 / 255e0) AS su, 0.5e0 / (1e0 - kr) * (224 / 255e0) AS sv FROM w)
SELECT n_nationkey, CAST(floor(kr * (219 / 255e0) * 65536 + 0.5) AS BIGINT) AS yr, CAST(floor(kg * (219 / 255e0) * 65536 + 0.5) AS BIGINT) AS yg, CAST(floor(kb * (219 / 255e0) * 65536 + 0.5) AS BIGINT) AS yb, CAST(1048576 AS BIGINT) AS y0,
 CAST(floor(-kr * su * 65536 + 0.5) AS BIGINT) AS ur, CAST(floor(-kg * su * 65536 + 0.5) AS BIGINT) AS ug, CAST(floor((1e0 - kb) * su * 65536 + 0.5) AS BIGINT) AS ub, CAST(8388608 AS BIGINT) AS u0,
 CAST(floor((1e0 - kr) * sv * 65536 + 0.5) AS BIGINT) AS vr, CAST(floor(-kg * sv * 65536 + 0.5) AS BIGINT) AS vg, CAST(floor(-kb * sv * 65536 + 0.5) AS BIGINT) AS vb, CAST(8388608 AS BIGINT) AS v0 FROM m""")
def derived_matrices(spark, sf_dir):
    """Matrices from luma weights, limited range."""
    n = F.col("n_nationkey")
    kr, kb = 0.2 + n % 5 * 0.03, 0.05 + n % 7 * 0.01
    return table(spark, sf_dir, "nation").select("n_nationkey", *[c.alias(f"{p}{k}") for c, (p, k) in zip(P.colour_matrix(kr, kb), ((p, k) for p in "yuv" for k in "rgb0"))])


_SEEDS = "[232870448, 62068870, 2002758859, 478700138, 1748524117, 347322408, 1250295544, 1239267403, 1694299031, 1549075081, 1244200960, 226410970, 1497413547, 1418876797, 1310313074, 953388137, 201453157, 849442143, 1412953682, 1522215986, 262821809, 1945449447, 1751117530, 1969474786, 1855524483, 1194371053, 1338038726, 1231754556, 1326711802, 1411054348, 1939409714, 651676444, 1875654406, 750483416, 1970679594, 1680198877, 615732321, 175998741, 570692776, 337559399, 1454642563, 1944388323, 1154134383, 673598786, 1941614331, 173075437, 493532923, 221959179, 903560040, 721952387, 2010016661, 1367467504, 2021997500, 10458260, 669379900]"


@query(f"""WITH RECURSIVE z(k, s) AS (SELECT 0, {_SEEDS} UNION ALL SELECT k + 24, list_concat(s, list_transform(range(24), lambda j: (s[k + j + 1] - s[k + j + 32] + 2147483648) % 2147483648)) FROM z WHERE k < 4800),
d AS (SELECT i, s[i + 56] AS d FROM (SELECT s FROM z ORDER BY k DESC LIMIT 1) CROSS JOIN range(4800) r(i)), e AS (SELECT i, CASE WHEN d < 1073741824 THEN d ELSE d - 2147483648 END AS d FROM d)
SELECT event_id, CAST((((d >> 23) * 128) >> 8) + 128 AS INT) AS offset_value FROM events JOIN e ON e.i = event_id % 4800""")
def dither_offsets(spark, sf_dir):
    """Dither of 8 bits and half strength, by place."""
    values = P.dither(4800, 8, 0.5)
    rows = spark.createDataFrame(list(enumerate(values)), "i long, offset_value int")
    return table(spark, sf_dir, "events").join(F.broadcast(rows), F.col("i") == F.col("event_id") % 4800).select("event_id", "offset_value")


@query(f"""WITH {PIXEL_SQL} SELECT y, x, """ + ", ".join(f"CAST(CASE WHEN a = 255 THEN {c} WHEN a = 0 THEN 0 ELSE (({c} * (CAST(a AS BIGINT) * 65793) + 8388608) & 4294967295) >> 24 END AS INT) AS {c}, CAST(CASE WHEN a = 255 THEN least({c}, a) WHEN a = 0 THEN 0 ELSE ((least({c}, a) * (4278190080 // greatest(a, 1)) + 8388608) & 4294967295) >> 24 END AS INT) AS own_{c}" for c in "rgb") + " FROM px")
def premultiplied_channels(spark, sf_dir):
    c, a = {n: F.col(n) for n in "rgb"}, F.col("a")
    return pixels(spark, sf_dir).select("y", "x", *[e.alias(n) for k in "rgb" for n, e in ((k, P.premultiplied(c[k], a)), (f"own_{k}", P.premultiplied(F.least(c[k], a), a, True)))])


@query(f"WITH {PIXEL_SQL} SELECT y, x, CAST(CASE WHEN r - 128 < 0 THEN -((abs(r - 128) + 9) // 19) ELSE (abs(r - 128) + 9) // 19 END AS INT) AS level, CAST(CASE WHEN r - 128 < 0 THEN -((abs(r - 128) + 9) // 19) ELSE (abs(r - 128) + 9) // 19 END * 19 AS INT) AS back FROM px")
def quantised_levels(spark, sf_dir):
    """Numbers of steps of 19, and the values that come back."""
    level = P.quantised(F.col("r") - 128, 19)
    return pixels(spark, sf_dir).select("y", "x", level.alias("level"), P.dequantised(level, 19).alias("back"))


@query(f"""WITH {_PHOTO}, s AS (SELECT image_id, y // 2 AS by, x // 2 AS bx, count(*) AS n, sum(a) AS sa, """ + ", ".join(f"CAST(sum(floor(pow({c} / 255e0, 0.8e0) * 4095 + 0.5)) AS BIGINT) AS s{c}, CAST(sum(a * floor(pow({c} / 255e0, 0.8e0) * 4095 + 0.5)) AS BIGINT) AS w{c}" for c in "rgb") + """ FROM ph GROUP BY ALL),
t AS (SELECT *, 4 // n AS f, CAST(sa * (4 // n) AS BIGINT) AS al FROM s), v AS (SELECT *, """ + ", ".join(f"CAST(CASE WHEN al IN (0, 1020) THEN s{c} * f ELSE (w{c} * f * (524288 // greatest(al, 1))) >> 17 END AS BIGINT) AS v{c}" for c in "rgb") + """ FROM t)
SELECT image_id, "by", bx, """ + ", ".join(f"CAST((CAST(floor(pow((least(v{c} >> 9, 31) + 1) * (128e0 / 4095), 1.25e0) * 255 + 0.5) AS BIGINT) * (v{c} & 511) + CAST(floor(pow(least(v{c} >> 9, 31) * (128e0 / 4095), 1.25e0) * 255 + 0.5) AS BIGINT) * (512 - (v{c} & 511)) + 64) >> 7 AS INT) AS {c}4" for c in "rgb") + ", CAST(al AS INT) AS a4 FROM v")
def chroma_in_linear_light(spark, sf_dir):
    """Gamma-aware averages of the images' 2 x 2 blocks, weighed by alpha."""
    from ..operators.planes import chroma_sums

    return chroma_sums(photos(spark, sf_dir), "image_id")


@query(f"WITH {_PHOTO} SELECT image_id, min(a) < 255 AS has_alpha, count(DISTINCT a) AS alphas FROM ph GROUP BY image_id")
def translucent_images(spark, sf_dir):
    from ..operators.planes import translucent

    return translucent(photos(spark, sf_dir), "image_id")


@query(f"""WITH {_PHOTO}, {_cells('ph', 64)}, q AS (SELECT c.image_id, c.y, c.x, """ + ", ".join(f"coalesce({n}, 0) AS {n}" for n in "rgba") + """ FROM cells c LEFT JOIN ph USING (image_id, y, x))
SELECT q.image_id, q.y, q.x, """ + ", ".join(f"CAST(CASE WHEN s.y IS NOT NULL THEN s.{n} WHEN q.x < 4 THEN {v} ELSE q.{n} END AS INT) AS {n}" for n, v in zip("rgba", (9, 8, 7, 255))) + """
FROM q LEFT JOIN q s ON s.image_id = q.image_id AND s.y = q.y - 48 AND s.x = q.x - 20 AND s.y BETWEEN 2 AND 31 AND s.x BETWEEN 30 AND 59""")
def cropped_and_pasted(spark, sf_dir):
    """A piece of each image laid over it elsewhere, partly beyond the edge, after a stripe was filled."""
    from ..codec import columns as C
    from ..operators import images as I

    images = C.images_of(photos(spark, sf_dir), "image_id", 64, 64)
    piece = I.cropped(images, "image_id", 30, 2, 30, 30)
    return C.pixel_rows(I.pasted(I.filled(images, "image_id", -3, 0, 7, 99, (9, 8, 7, 255)), piece, "image_id", 50, 50), "image_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ycbcr' WHEN doc_id % 3 = 1 THEN 'rgba' END AS colour_model, CASE WHEN doc_id % 3 < 2 THEN CAST(doc_id % 500 + 1 AS INT) END AS width, CASE WHEN doc_id % 3 < 2 THEN CAST(doc_id % 300 + 1 AS INT) END AS height,
 CASE WHEN doc_id % 3 = 2 THEN 'truncated chunk' END AS error FROM documents""")
def decode_configs(spark, sf_dir):
    """Colour model and size without decoding: lossy, lossless and cut files."""
    from ..sources.tables import config

    d = F.col("doc_id")
    w, h = d % 500 + 1, d % 300 + 1
    lossy = B.riff(B.chunk("VP8 ", B.lossy_header_bytes(w, h)))
    lossless = B.riff(B.chunk("VP8L", B.lossless_header_bytes(w, h, F.lit(0))))
    content = F.when(d % 3 == 0, lossy).when(d % 3 == 1, lossless).otherwise(F.substring(lossless, F.lit(1), F.lit(22)))
    return config(table(spark, sf_dir, "documents").select("doc_id", content.alias("content")), "doc_id")


@query("""SELECT event_id, CAST(CASE WHEN event_id % 9 = 0 THEN 9223372036854775800 ELSE event_id END AS BIGINT) AS x0, event_id % 50 AS y0, CASE WHEN event_id % 9 = 0 AND event_id % 20 > 7 THEN 9223372036854775807 WHEN event_id % 9 = 0 THEN 9223372036854775800 + event_id % 20 ELSE event_id + event_id % 20 END AS x1, event_id % 50 + 3 AS y1 FROM events""")
def frame_rectangles(spark, sf_dir):
    """Frames' rectangles, some of them at the end of what 64 bits hold."""
    from ..operators.animation import frame_bounds

    e = F.col("event_id")
    x = F.when(e % 9 == 0, (1 << 63) - 8).otherwise(e)
    return table(spark, sf_dir, "events").select("event_id", frame_bounds(x, e % 50, e % 20, F.lit(3)).alias("s")).select("event_id", "s.*")
