"""The corpus pipeline, stage by stage, on a small fixture of its own."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from docloom.llm import bpe
from docloom.llm.queries import vocabulary


def _fixture(spark, tmp_path):
    r = random.Random(1)
    say = lambda n: " ".join("".join(r.choices(["ka", "lo", "mi", "ta", "ne", "ru"], k=r.randint(2, 4))) for _ in range(n))
    item = say(30)
    rows = [(i, say(80), "aa", "s", 0) for i in range(30)]
    rows += [(100, f"{rows[0][1]}\na line that many share", "aa", "s", 0), (101, f"{say(60)}\nA line that many share ", "aa", "s", 0), (102, f"{say(40)} {item} {say(20)}", "aa", "s", 0)]
    rows += [(103, None, "aa", "s", 0), (104, "12 34", "aa", "s", 0), (105, "", None, None, 0), (106, rows[1][1] + " tail", None, "s", 0)]
    path = str(tmp_path / "sf")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("keep", F.lit("extra"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, tmp_path):
    path = _fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    kept = {}
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, path)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {x.doc_id: x for x in docs.collect()}
    everything = set(range(30)) | {100, 101, 102, 106}
    assert set(kept["language"]) == everything
    assert set(kept["line_dedup"]) == everything and kept["line_dedup"][101].text.count("\n") == 0 and kept["line_dedup"][101].n_chars == len(kept["line_dedup"][101].text)
    assert kept["line_dedup"][100].text == "a line that many share"  # its other line is that of document 0
    assert set(kept["near_dedup"]) == everything - {106}
    assert set(kept["decontaminate"]) == everything - {102, 106}
    codec = bpe.codec(bpe.read_spec(vocabulary()))
    assert all(x.ids == codec.encode(x.text).tolist() and x.n_tokens == len(x.ids) for x in kept["bpe"].values())
    whole = {x.doc_id for x in P.run(spark, path).collect()}
    assert whole == set(kept["bpe"])


def test_empty_and_unlabelled(spark, tmp_path):
    path = _fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert {x.doc_id for x in P.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), path).collect()} >= set(range(30))
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0


def _brute(rows, bench):
    """Every stage in plain Python; rows are (doc_id, text, lang), null ids are the least."""
    import re
    import zlib

    import test_operators as O

    from docloom.llm import near_dedup

    # 8: all labelled documents outside the held-out fifth are few enough to be the sample.
    learned = [(t, lang) for i, t, lang in rows if lang and t is not None and zlib.crc32(str("" if i is None else i).encode()) % 5]
    judged = O._language_brute(learned, [t for _, t, _ in rows])
    rows = [r for r, (lang, score, support) in zip(rows, judged, strict=True) if lang != "und" and score >= P.LEAST_SCORE and support >= P.LEAST_SUPPORT]
    # 3
    least = -(2**63)
    lines = O._line_brute([(least if i is None else i, t) for i, t, _ in rows])
    texts = {}
    for i, t, _, _ in lines:
        texts.setdefault(i, []).append(t)
    # 10
    shingled = {i: near_dedup.shingles(near_dedup.words_of(t[0])) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            same = re.findall(r"\w+", texts[i][0].lower()) == re.findall(r"\w+", texts[j][0].lower()) != []
            if same or near_dedup.similarity(shingled[i], shingled[j]) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    texts = {i: t for i, t in texts.items() if find(i) == i}
    # 2
    leaked = {i for i, _ in O._decontaminate_brute([(i, t[0]) for i, t in texts.items()], bench)}
    return {i: t for i, t in texts.items() if i not in leaked}


def test_whole_pipeline_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(7)
    sounds = {"aa": ["ka", "lo", "mi", "ta", "ne"], "bb": ["schu", "wer", "gei", "tz", "on"]}
    say = lambda lang, n: " ".join("".join(r.choices(sounds[lang], k=r.randint(2, 4))) for _ in range(n))
    bench = [(1, say("aa", 30)), (2, say("bb", 12)), (3, None), (4, "")]
    rows = [(i, "\n".join(say(lang, r.randint(5, 30)) for _ in range(r.randint(1, 5))), lang) for i, lang in enumerate(r.choices(["aa", "bb"], k=60))]
    shared = [say("aa", 9), say("bb", 9)]
    for k in range(12):
        i, text, lang = rows[r.randrange(60)]
        words = text.split(" ")
        words[r.randrange(len(words))] = "changed"
        rows.append((100 + k, " ".join(words), lang))  # near copies, that lose their common lines first
        rows.append((200 + k, f"{say('bb', 20)} {bench[k % 2][1]} {say('aa', 8)}\n{shared[k % 2]}", None))
    rows += [(300, "ΑΒΓ δε ζη " * 20, None), (301, "12 ½", "aa"), (302, None, "aa"), (303, "", None), rows[3], rows[3], (None, say("aa", 40), "aa"), (304, say("aa", 3000), None)]
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("id", F.lit("clash")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    want = _brute(rows, bench)
    out = P.run(spark, path).collect()
    got = {}
    for x in out:
        got.setdefault(-(2**63) if x.doc_id is None else x.doc_id, []).append(x.text)
    assert got == want and len(want) > 50
    lib = Tokenizer.from_file(vocabulary())
    assert all(x.ids == lib.encode(x.text, add_special_tokens=False).ids for x in out) and {x.id for x in out} == {"clash"}
