import random
import zlib

import corpus_pipeline as C
from strandloom.llm import _io, packing, quality, simhash
from tests.llm.test_mixing import brute_targets
from tests.llm.test_packing import bfd
from tests.llm.test_simhash import brute_groups, brute_print
from tests.llm.test_suffixes import brute


def corpus(tmp, spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))
    passage = " ".join(word() for _ in range(120))
    rows, labels = [], []
    for i in range(240):
        good = rnd.random() < 0.8
        text = " ".join(word() for _ in range(rnd.randint(20, 150)))
        if i % 9 == 0:
            text += " " + passage
        rows.append((i, text if good else text.replace(" ", "$$$ ") + "###", rnd.choice("en de".split()), "s%d" % rnd.randint(0, 3), len(text)))
        labels.append((i, int(good), 0))
    rows += [(300 + k, rows[k][1], "en", "s0", 1) for k in range(0, 60, 3)] + [(400, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp}/labels.parquet")


def test_stages_against_brute_force(spark, tmp_path):
    corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = []
    for name, stage in C.STAGES:
        docs = _io.stored(stage(spark, docs, str(tmp_path)), "t")
        after.append(docs.collect())
        if name != C.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept, single, cut, mixed, packed = after
    ids = lambda rows: sorted(r.doc_id for r in rows)

    first = spark.read.parquet(f"{tmp_path}/documents.parquet")
    score = {r.doc_id: r.predicted for r in quality.score(first, quality.train(first, _io.table(spark, str(tmp_path), "labels"))).collect()}
    assert ids(kept) == sorted(i for i, p in score.items() if p) and not any("$$$" in (r.text or "") for r in kept)

    kept.sort(key=lambda r: r.doc_id)
    roots = brute_groups([brute_print(r.text) for r in kept])
    assert ids(single) == sorted({kept[r].doc_id for r in roots}) and len(single) < len(kept)

    single.sort(key=lambda r: r.doc_id)
    want = {r.doc_id: w[4].decode(errors="ignore") for r, w in zip(single, brute([(r.text or "").encode() for r in single], 400))}
    assert {r.doc_id: r.text or "" for r in cut} == want and len(cut) == len(single)
    assert sum(len(r.text or "") for r in cut) < sum(len(r.text or "") for r in single)
    assert all(r.n_chars == len(r.text) for r in cut if r.text is not None)

    size = {r.doc_id: len((r.text or "").split()) for r in cut}
    by_source, taken = {}, {}
    for r in cut:
        by_source[r.source] = by_source.get(r.source, 0) + size[r.doc_id]
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
    for s, t in brute_targets(by_source).items():
        assert abs(taken.get(s, 0) - t) <= max(60, 0.02 * t)

    cut_ = packing.cut(spark.createDataFrame(mixed, first.schema)).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in cut_)
    assert len({r.sequence_id for r in packed}) == len(bfd([r.length for r in packed], 2048))

    again = C.run(spark, str(tmp_path)).collect()
    key = lambda r: zlib.crc32(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)).encode())
    assert sorted(map(key, again)) == sorted(map(key, packed))


def test_names():
    assert [f.__module__ for _, f in C.STAGES] == ["corpus_pipeline"] * 5 and C.ORACLE_SQL is None
    assert simhash.DISTANCE == 4


def test_near_dedup_links_by_simhash_and_by_the_exact_check(spark, tmp_path, monkeypatch):
    """A chain over both kinds of links is one group; SimHash alone, and the exact check alone, leave more."""
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    near = words[:300]
    near[150] = "other"  # one word of 300: similar by shingles
    rows = [(1, " ".join(words[:300])), (2, " ".join(near)), (3, " ".join(words[100:200])), (4, " ".join(words[:300])), (None, " ".join(words[:300])), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    asked = []
    true = simhash.near_duplicates

    def linked(docs, **options):
        asked.append(1)
        out = true(docs, **options)
        # 3 and 2 as if their fingerprints were near: only this link joins them
        ids = docs.where("size(split(text, ' ')) = 100").select("doc_id").first()[0], docs.where("text LIKE '%other%'").select("doc_id").first()[0]
        lowest = min(ids)
        return out.selectExpr("doc_id", "fingerprint", f"CASE WHEN doc_id IN ({ids[0]}, {ids[1]}) THEN {lowest} ELSE component_id END AS component_id")

    monkeypatch.setattr(simhash, "near_duplicates", linked)
    kept = C.near_dedup(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) in ([1, 5], [1, 5, 6]) and asked == [1]
