"""Streams: growing files, batches that are visible as a whole, bursts with late rows and replay."""

import os
import random

import pytest
from helpers import BROWSER, requests, row
from pyspark.errors import StreamingQueryException

from logsieve.operators import bursts, score
from logsieve.sources import tail
from logsieve.streaming import bursts as stream_bursts
from logsieve.streaming import commits, ingest

PATHS = ["/admin/", "/backup.zip", "/phpmyadmin", "/vendor/", "/storage/", "/config.php"]  # two of them are no probes


def append(path, *lines, end="\n"):
    with open(path, "a", encoding="utf-8") as f:
        f.write("\n".join(lines) + end)


class Follower:
    """A query over followed files whose micro-batches are awaited one by one."""

    def __init__(self, spark, pattern, checkpoint, **options):
        self.spark, self.pattern, self.checkpoint, self.options, self.got = spark, pattern, checkpoint, options, []
        self.start()

    def start(self):
        rows = ingest.follow(self.spark, self.pattern, flushSeconds=0, **self.options)
        sink = lambda batch, i: self.got.extend(r.value for r in batch.collect())
        self.query = ingest.start(rows, sink, self.checkpoint, once=False, every="0 seconds")

    def new(self):
        self.query.processAllAvailable()
        out, self.got = sorted(self.got), []
        return out


def test_growing_rotated_and_cut_files(spark, tmp_path):
    os.makedirs(f"{tmp_path}/log")
    log = f"{tmp_path}/log/access.log"
    append(log, "a1", "a2", "a3 unfini", end="")
    f = Follower(spark, f"{tmp_path}/log/access.log*", f"{tmp_path}/cp", sliceBytes=3)
    assert f.new() == ["a1", "a2"]
    append(log, "shed", "a4 é\udcff".encode("utf-8", "replace").decode())
    assert f.new() == ["a3 unfinished", "a4 é?"]
    append(log, "a5 before the rotation", "last without an end", end="")
    os.rename(log, f"{log}.1")
    append(log, "b1")
    assert f.new() == ["a5 before the rotation", "b1", "last without an end"]
    f.query.stop()
    append(log, "b2 while nobody looked")
    f.start()  # from the checkpoint
    assert f.new() == ["b2 while nobody looked"]
    with open(log, "w") as out:  # cut off
        out.write("c1\n")
    assert f.new() == ["c1"]
    append(log, "", "c3")
    assert f.new() == ["", "c3"]
    assert f.new() == []
    f.query.stop()


def test_a_replaced_file_of_equal_size_is_read_again(spark, tmp_path):
    log = f"{tmp_path}/x.log"
    append(log, "one", "two")
    f = Follower(spark, log, f"{tmp_path}/cp")
    assert f.new() == ["one", "two"]
    with open(log, "w") as out:
        out.write("uno\ndos\n")
    assert f.new() == ["dos", "uno"]
    f.query.stop()


def test_batches_begin_by_size_or_age(tmp_path):
    log = f"{tmp_path}/x.log"
    reader = tail.TailReader({"path": log, "flushbytes": "10", "flushseconds": "1000"})
    assert reader.latestOffset() == {"files": {}}
    append(log, "short")
    assert reader.latestOffset() == {"files": {}}  # neither large nor old
    append(log, "long enough")
    (end,) = [x["end"] for x in reader.latestOffset()["files"].values()]
    assert end == os.path.getsize(log)
    append(log, "s")
    assert [x["end"] for x in reader.latestOffset()["files"].values()] == [end]
    reader.flush_seconds = 0.0
    assert [x["end"] for x in reader.latestOffset()["files"].values()] == [end + 2]


def test_slices_cut_at_lines(tmp_path):
    log, rnd = f"{tmp_path}/x.log", random.Random(1)
    lines = ["x" * rnd.randrange(0, 9) for _ in range(200)]
    append(log, *lines)
    for size in (1, 2, 7, 64, 10_000):
        reader = tail.TailReader({"path": log, "flushseconds": "0", "slicebytes": str(size)})
        parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
        assert [x for p in parts for b in reader.read(p) for x in b.column("value").to_pylist()] == lines


def kinds(tmp_path, spark, n=6):
    for i in range(n):
        os.makedirs(f"{tmp_path}/in/kind=access", exist_ok=True)
        append(f"{tmp_path}/in/kind=access/{i}.txt", f'10.0.0.{i} - - [01/Apr/2026:15:00:0{i} +0000] "GET /{i} HTTP/1.1" 200 5 "-" "x" "h" "v"')
    return f"{tmp_path}/in"


def test_half_a_batch_is_never_seen(spark, tmp_path):
    folder, base, cp = kinds(tmp_path, spark), f"{tmp_path}/out", f"{tmp_path}/cp"
    write, seen = ingest.tables_writer(base), []

    def uris(table="access"):
        return sorted(r.uri for r in ingest.read_sink(spark, base, table).collect())

    def failing(batch, batch_id):
        if batch_id < 1:
            return write(batch, batch_id)
        seen.append(uris())
        ingest.logs.PARSERS["access"](batch.select("value")).write.mode("overwrite").parquet(f"{base}/access/batch_id={batch_id}")
        seen.append(uris())
        raise RuntimeError("lost")

    with pytest.raises(StreamingQueryException, match="lost"):
        ingest.start(ingest.stream_kinds(spark, folder, 3), failing, cp).awaitTermination()
    assert seen[0] == seen[1] == uris() and len(seen[0]) == 3
    assert commits.last_commit(spark, base) == (0, {"access": 3, "security": 0, "error": 0})
    ingest.start(ingest.stream_kinds(spark, folder, 3), write, cp).awaitTermination()
    assert uris() == [f"/{i}" for i in range(6)] and uris("error") == []
    assert commits.last_commit(spark, base)[1]["access"] == 3


def test_nothing_committed(spark, tmp_path):
    assert commits.last_commit(spark, f"{tmp_path}/none") is None
    assert commits.read_committed(spark, f"{tmp_path}/none", schema="a int").collect() == []
    with pytest.raises(ValueError):
        commits.read_committed(spark, f"{tmp_path}/none")


def view(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def probing():
    rnd, at, out = random.Random(7), 0.0, []
    for i in range(1, 300):
        at += rnd.choice([0.0, 0.5, 7, 40, 60, 121, 300])
        out.append((i, rnd.choice(PATHS), at, f"ip{rnd.choice([1, 1, 1, 2])}", rnd.choice([200, 404]), rnd.choice(["text/html", None, "a/b"])))
    return out


def rows_of(spark, some):
    return requests(spark, [row(i, p, at, src_ip=ip, status_code=st, resp_content_type=ct, response_body_bytes=777) for i, p, at, ip, st, ct in some])


def test_stream_bursts_have_the_whole_record(spark, tmp_path, probing):
    last = probing[-1][2]
    closing = (10_000, "/admin/", last + 90_000, "closing", 200, None)
    jittered = sorted(probing, key=lambda r: r[2] + random.Random(r[0]).uniform(0, 500))  # out of order, less than ten minutes
    write = stream_bursts.tracker(f"{tmp_path}/b", "10 minutes")
    parts = [jittered[a : a + 60] for a in range(0, len(jittered), 60)] + [[closing]]
    for i, part in enumerate(parts):
        write(rows_of(spark, part), i)
        if i == 2:  # a failure after the note: the batch is run again
            write(rows_of(spark, part), i)
    got = view(stream_bursts.read_bursts(spark, f"{tmp_path}/b"))
    assert got and got == view(bursts.probing_bursts(rows_of(spark, probing)))
    assert commits.last_commit(spark, f"{tmp_path}/b")[1]["late_total"] == 0


def test_a_failed_batch_of_bursts_is_run_again(spark, tmp_path, probing, monkeypatch):
    write = stream_bursts.tracker(f"{tmp_path}/b", "1 minutes")
    half = len(probing) // 2
    write(rows_of(spark, probing[:half]), 0)
    before = view(stream_bursts.read_bursts(spark, f"{tmp_path}/b"))
    with monkeypatch.context() as m:
        m.setattr(commits, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            write(rows_of(spark, probing[half:]), 1)
    assert view(stream_bursts.read_bursts(spark, f"{tmp_path}/b")) == before
    write(rows_of(spark, probing[half:]), 1)
    write(rows_of(spark, [(10_000, "/admin/", probing[-1][2] + 9000, "closing", 200, None)]), 2)
    assert view(stream_bursts.read_bursts(spark, f"{tmp_path}/b")) == view(bursts.probing_bursts(rows_of(spark, probing)))


def test_late_probes_are_dropped_and_counted(spark, tmp_path):
    write = stream_bursts.tracker(f"{tmp_path}/b", "5 minutes")
    early = [(i, p, i, "a", 200, None) for i, p in enumerate(PATHS, 1)]
    write(rows_of(spark, early), 0)
    assert view(stream_bursts.read_bursts(spark, f"{tmp_path}/b")) == []
    write(rows_of(spark, [(50, "/admin/", 1000, "b", 200, None), (51, "/backup.sql", 3, "a", 200, None)]), 1)  # within the lateness
    write(rows_of(spark, [(60, "/admin/config.php", 4, "a", 200, None)]), 2)
    (burst,) = stream_bursts.read_bursts(spark, f"{tmp_path}/b").collect()
    assert burst.request_count == 5 and burst.distinct_path_count == 5 and burst.interpretation_hint.startswith("Multiple low-signal")
    note = commits.last_commit(spark, f"{tmp_path}/b")[1]
    assert (note["late"], note["late_total"]) == (1, 1)
    empty = rows_of(spark, [])
    write(empty, 3)
    assert commits.last_commit(spark, f"{tmp_path}/b")[1]["watermark"] == note["watermark"]


def test_noise_windows_end_by_the_time_of_any_request(spark, tmp_path):
    """The last request is a candidate and no noise; its time still ends the windows before it."""
    noise = [row(i, "/", at=i, user_agent=BROWSER) for i in range(5)]
    attack = row(9, "/search?q='%20union%20select%201,2%20from%20users--", at=7200)
    for rows in (noise, [attack]):
        part = requests(spark, rows)
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    left = score.filtered(score.judge(ingest.watermarked(stream, "10 minutes")))
    sink = ingest.noise_windows(left).writeStream.format("parquet").option("path", f"{tmp_path}/out")
    sink.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert [r["count"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [5]
