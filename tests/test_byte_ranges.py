import random

import pytest

from strandloom.sources import byte_ranges as B
from strandloom.sources import text as T


def write_reads(path, first, n, seed=0):
    rnd = random.Random(seed)
    rows = []
    with open(path, "w", newline="") as f:
        for i in range(first, first + n):
            seq = "".join(rnd.choice("ACGTN") for _ in range(rnd.randint(1, 60)))
            quality = "".join(rnd.choice("@+I#") for _ in seq)
            f.write(f"@r{i} x\n{seq}\n+\n{quality}\n")
            rows.append((f"r{i} x", seq))
    return rows


@pytest.mark.parametrize("step", [1, 7, 64, 1000, 1 << 20])
def test_every_range_size_gives_every_record_once(tmp_path, step):
    path = str(tmp_path / "a.fq")
    rows = write_reads(path, 0, 40 if step < 64 else 300)
    reader = B.FastqReader({"path": path, "rangebytes": str(step)})
    got = [(r["name"], r["seq"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert got == rows


@pytest.mark.parametrize("text, want", [
    ("", []),
    ("junk\n\n@a\nAC\n+\n@@\n\n@b\r\nG\r\n+\r\n+\r\n", [("a", "AC"), ("b", "G")]),
    ("@a\nAC\n+\n@@\n@b\nGT", [("a", "AC"), ("b", "GT")]),
    ("@a\nAC\n+\n@@\n@b\n", [("a", "AC")]),
    ("@a\n\n+\n\n@b\nT\n+\nI\n", [("a", ""), ("b", "T")]),
])
def test_odd_files(tmp_path, text, want):
    path = tmp_path / "a.fq"
    path.write_bytes(text.encode())
    for step in (1, 3, 100):
        reader = B.FastqReader({"path": str(path), "rangebytes": str(step)})
        got = [(r["name"], r["seq"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert got == want, step


def test_batch_reads_a_folder(spark, tmp_path):
    folder = tmp_path / "reads"
    folder.mkdir()
    rows = write_reads(folder / "a.fq", 0, 500) + write_reads(folder / "b.fq", 500, 300, 1)
    (folder / "_SUCCESS").write_text("")
    got = B.fastq_ranges(spark, folder.as_uri(), 2000)
    assert got.rdd.getNumPartitions() > 10
    assert sorted((r.name, r.seq) for r in got.collect()) == sorted(rows)


def test_fasta_pieces_and_pruning(spark, tmp_path):
    rnd = random.Random(2)
    bodies = {f"c{i}": "".join(rnd.choice("ACGT") for _ in range(n)) for i, n in enumerate([0, 1, 60, 61, 5000, 12345])}
    path, index = tmp_path / "g.fa", tmp_path / "index"
    path.write_text("".join(f">{k} about\n" + "".join(v[a : a + 60] + "\n" for a in range(0, len(v), 60)) for k, v in bodies.items()))
    T.fasta_index(spark, str(path)).selectExpr("concat_ws(' ', name, pos, len) AS value").write.text(str(index))
    rows = B.fasta_pieces(spark, path.as_uri(), index.as_uri(), range_bytes=1000).collect()
    for k, v in bodies.items():
        mine = sorted((r.start, r.bases) for r in rows if r.name == k)
        assert "".join(b for _, b in mine) == v and all(v[s : s + len(b)] == b for s, b in mine)
    some = B.fasta_pieces(spark, path.as_uri(), index.as_uri(), ["c3", "c4"], 1000).collect()
    assert {r.name for r in some} == {"c3", "c4"}
    reader = B.FastaReader({"path": str(path), "index": str(index), "rangebytes": "1000", "taskbytes": "2500"})
    assert not list(reader.pushFilters([B.EqualTo(("name",), "c4")]))
    parts = reader.partitions()
    assert {r.name for p in parts for r in p.ranges} == {"c4"} and [len(p.ranges) for p in parts] == [2, 2, 2]
    assert not B.fasta_pieces(spark, path.as_uri(), index.as_uri(), ["none"]).count()


def test_stream_fails_and_goes_on(spark, tmp_path):
    folder, out, state = tmp_path / "reads", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    rows = write_reads(folder / "a.fq", 0, 400) + write_reads(folder / "b.fq", 400, 200, 1)
    sizes = {}

    def write(df, number):
        df.select("name", "seq").write.mode("overwrite").parquet(f"{out}/batch={number}")
        sizes[number] = spark.read.parquet(f"{out}/batch={number}").count()

    def failing(df, number):
        if number == 2:
            raise ValueError("lost")
        write(df, number)

    def go(to):
        B.stream_fastq(spark, folder.as_uri(), to, state, batch_bytes=8000)
        return sorted((r.name, r.seq) for r in spark.read.parquet(out).select("name", "seq").collect())

    with pytest.raises(Exception, match="lost"):
        go(failing)
    assert set(sizes) == {0, 1}
    assert go(write) == sorted(rows)
    assert len(sizes) > 4 and max(sizes.values()) < 200
    rows += write_reads(folder / "c.fq", 600, 50, 2)  # comes later
    assert go(write) == sorted(rows)
    done = dict(sizes)
    assert go(write) == sorted(rows) and sizes == done  # nothing new


def test_batches_follow_the_cluster_not_the_input(spark, tmp_path):
    """Without a size of its own a stream takes bytes by cores: a few MB are one batch, where 640 kB each made many."""
    folder, numbers = tmp_path / "reads", []
    folder.mkdir()
    rows = write_reads(folder / "a.fq", 0, 30_000)
    assert (folder / "a.fq").stat().st_size > 3 * B.BATCH
    got = []

    def write(df, number):
        got.extend((r.name, r.seq) for r in df.select("name", "seq").collect())
        numbers.append(number)

    B.stream_fastq(spark, folder.as_uri(), write, str(tmp_path / "state"))
    assert sorted(got) == sorted(rows) and numbers == [0]


def test_a_folder_is_read_as_its_files_joined(spark, tmp_path):
    """Places count over the files of a folder in order of name, and pieces are read back from them; one task need not hold all."""
    rnd = random.Random(3)
    bodies = {f"c{i}": "".join(rnd.choice("ACGT") for _ in range(n)) for i, n in enumerate([0, 70, 5000, 60, 0, 333])}
    text = {k: f">{k} about\n" + "".join(v[a : a + 60] + "\n" for a in range(0, len(v), 60)) for k, v in bodies.items()}
    folder, one, index = tmp_path / "many", tmp_path / "one.fa", tmp_path / "index"
    folder.mkdir()
    for i, names in enumerate([["c0", "c1"], ["c2"], ["c3", "c4"], ["c5"]]):
        (folder / f"part-{i}.txt").write_text("".join(text[k] for k in names))
    one.write_text("".join(text.values()))
    want = sorted((r.name, r.pos, r.len) for r in T.fasta_index(spark, str(one)).collect())
    found = T.fasta_folder_index(spark, folder.as_uri())
    assert sorted(map(tuple, found.collect())) == want
    found.selectExpr("concat_ws(' ', name, pos, len) AS value").write.text(str(index))
    rows = B.fasta_pieces(spark, folder.as_uri(), index.as_uri(), range_bytes=1000).collect()
    for k, v in bodies.items():
        assert "".join(b for _, b in sorted((r.start, r.bases) for r in rows if r.name == k)) == v
