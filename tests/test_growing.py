"""Lines of files that grow between batches."""

import io
import random

from graphloom.sources.growing import BACK, GrowingLines, lines, splits


def test_every_line_in_one_split():
    """However the bytes are cut into batches and splits, each line comes once, from where it begins."""
    rnd = random.Random(1)
    for _ in range(300):
        data = b"".join(rnd.choice([b"", b"a", b"bb\xc3\xa9", b"c" * rnd.randint(0, 40)]) + rnd.choice([b"\n", b"\n", b""]) for _ in range(rnd.randint(0, 30)))
        want, at = [], 0
        for line in data.split(b"\n")[:-1]:
            want.append((at, line))
            at += len(line) + 1
        cuts = sorted({0, len(data), *(rnd.randint(0, len(data)) for _ in range(4))})
        got = []
        for a, b in zip(cuts, cuts[1:]):
            for s in splits({"f": a}, {"f": b}, rnd.randint(1, 20)):
                got += list(lines(io.BytesIO(data[:b]), s.start, s.end))
        assert got == want
    long = b"x" * (3 * BACK) + b"\ny\n"
    assert list(lines(io.BytesIO(long), 2 * BACK, len(long))) == [(0, b"x" * (3 * BACK)), (3 * BACK + 1, b"y")]
    assert [(s.start, s.end) for s in splits({"f": 9, "gone": 4}, {"f": 5, "new": 3}, 4)] == [(0, 4), (4, 5), (0, 3)]


def test_appended_lines_come_once(spark, tmp_path):
    """Two batches and a restart; the cut last line waits for its end, other files are left alone."""
    spark.dataSource.register(GrowingLines)
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)

    def add(name, text):
        with open(folder / name, "ab") as f:
            f.write(text.encode())

    def run():
        stream = spark.readStream.format("growing_lines").option("path", str(tmp_path / "in")).option("split", "7").load()
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["file"].rsplit("/", 1)[1], r["at"], r["line"]) for r in spark.read.parquet(f"{tmp_path}/rows").collect())

    add("a.jsonl", '{"x": 1}\n{"x": ')
    add("b.txt", "no\n")
    assert run() == [("a.jsonl", 0, '{"x": 1}')]
    assert run() == [("a.jsonl", 0, '{"x": 1}')]
    add("a.jsonl", '2}\r\nthird é\n')
    add("c.jsonl", "new\n\nlast")
    want = [("a.jsonl", 0, '{"x": 1}'), ("a.jsonl", 9, '{"x": 2}'), ("a.jsonl", 19, "third é"), ("c.jsonl", 0, "new"), ("c.jsonl", 4, "")]
    assert run() == want
    add("c.jsonl", "\n")
    assert run() == [*want, ("c.jsonl", 5, "last")]
