"""Streams of files and frames."""

from tests.test_containers import chunk, lossless, lossy, riff


def test_files_are_probed_as_they_arrive(spark, tmp_path):
    from pixelbrook.streaming import files

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.webp").write_bytes(riff(chunk("VP8L", lossless(5, 4, 1))))
    (folder / "b.webp").write_bytes(b"junk")
    query = files.probed(files.arriving(spark, str(folder))).writeStream.format("memory").queryName("probed_").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp"))
    query.start().awaitTermination(60)
    (folder / "c.webp").write_bytes(riff(chunk("VP8 ", lossy(7, 6))))
    got = {r.path.rsplit("/", 1)[1]: r for r in spark.table("probed_").collect()}
    assert (got["a.webp"].width, got["a.webp"].height, got["a.webp"].format) == (5, 4, "lossless") and got["b.webp"].error
    assert set(got) == {"a.webp", "b.webp"}


def test_frames_merge_in_a_stream(spark, tmp_path):
    from pixelbrook.streaming.animations import merged_frames

    source, out = str(tmp_path / "frames"), str(tmp_path / "out")
    rows = [(a, i, 10 * (i + 1), c, f"2024-01-01 00:00:{i:02d}") for a in (1, 2) for i, c in enumerate("xxyyyzx")]
    df = spark.createDataFrame(rows, "anim_id long, frame_idx long, duration_ms long, canvas string, t string").selectExpr("anim_id", "frame_idx", "duration_ms", "canvas", "cast(t as timestamp) ts")
    df.where("frame_idx < 5 and frame_idx <> 3").coalesce(1).write.parquet(source)  # frame 4 has to wait for frame 3
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda: merged_frames(stream).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(90)
    run()
    assert sorted((r.anim_id, r.frame_idx, r.start_ms, r.duration_ms, r.canvas) for r in spark.read.parquet(out).collect()) == [(a, 0, 0, 30, "x") for a in (1, 2)]
    df.where("frame_idx >= 3").coalesce(1).write.mode("append").parquet(source)
    late = df.limit(1).selectExpr("3L anim_id", "0L frame_idx", "1L duration_ms", "'q' canvas", "timestamp'2024-01-02' ts")
    late.write.mode("append").parquet(source)
    run()
    got = sorted((r.anim_id, r.frame_idx, r.start_ms, r.duration_ms, r.canvas) for r in spark.read.parquet(out).collect())
    assert {(1, 2, 30, 120, "y"), (1, 5, 150, 60, "z"), (2, 2, 30, 120, "y"), (2, 5, 150, 60, "z")} <= set(got)
