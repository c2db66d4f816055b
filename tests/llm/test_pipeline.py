"""The pipeline's stages on a small table, each against what its operator decides."""

from __future__ import annotations

import hashlib
import random
import re

import corpus_pipeline
import public_tokenizers
import tiktoken

from loomery.llm import bpe, decontamination, near_dedup, shared

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = [set(x.doc_id for x in docs.select("doc_id").collect())]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = shared.saved(stage(spark, docs, sf_dir), f"test-{name}")
        assert out.columns == docs.columns
        ids.append(set(x.doc_id for x in out.select("doc_id").collect()))
        assert ids[-1] <= ids[-2] and len(ids[-1]) == out.count()
        docs = out
    assert ids[1] < ids[0] and ids[2] == ids[1] and ids[3] < ids[2] and ids[4] < ids[3]
    assert near_dedup.near_duplicates(docs).filter("not kept").count() == 0
    assert decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in last.collect()} == ids[4]


def test_run_equals_the_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.saved(stage(spark, docs, sf_dir), f"test-{name}")
    assert sorted(docs.collect()) == sorted(corpus_pipeline.run(spark, sf_dir).collect())


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abdeilnorstuéß") for _ in range(rng.randint(2, 7))) for _ in range(n))


def _edited(text, seed, n):
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def _write(spark, path, docs, labels, items):
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def _drop_lines(docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().translate(LOWER).decode()
    holders = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    common = {k: max(h) for k, h in holders.items() if len(h) >= 5}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if common.get(key(x), i) == i)) for i, t in docs]


def _drop_copies(docs):
    sets = {}
    for i, t in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    head = {i: i for i, _ in docs}
    for _ in docs:  # as often as the longest chain needs at most
        for a, x in sets.items():
            for b, y in sets.items():
                if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                    head[a] = head[b] = min(head[a], head[b])
        if all(head[head[i]] == head[i] for i in head):
            break
    return [(i, t) for i, t in docs if head[i] == i]


def _drop_leaks(docs, items):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER))
    windows = {tuple(w[k : k + 10]) for _, t in items for w in [words(t)] for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    return [(i, t) for i, t in docs if not any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))]


def test_pipeline_equals_brute_force(spark, tmp_path):
    line = "This long line of a licence stands in many documents of the table."
    docs = [(i, f"{_prose(i, 30)} {'zorgla zorglen idiot' if i % 6 == 0 else ''}\n{line if i % 4 == 1 else 'end'}") for i in range(120)]
    base, leak = _prose(900, 60), _prose(901, 30)
    docs += [(200 + i, _edited(base, i, i % 4)) for i in range(8)] + [(300, f"{_prose(902, 20)} {leak.encode().upper().decode()} x"), (301, None), (302, ""), (303, "  \n"), (304, "one"), (305, base)]
    labels = [(i, 1, int(i % 6 == 0)) for i in range(120)]
    items = [(1, leak), (2, None), (3, "")]
    _write(spark, str(tmp_path), docs, labels, items)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, table, str(tmp_path)).collect()}
    assert not clean & {i for i in range(120) if i % 6 == 0} and len(clean) >= 110
    want = _drop_leaks(_drop_copies(_drop_lines([(i, t) for i, t in docs if i in clean])), items)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    rows = [(i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in want for ids in [library.encode_ordinary(t or "")]]
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(rows)
    assert {i for i, _ in want} >= {301, 302, 303, 304} and 300 not in {i for i, _ in want}


def test_pipeline_of_empty_tables_and_repeated_rows(spark, tmp_path):
    _write(spark, f"{tmp_path}/none", [], [], [])
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    _write(spark, f"{tmp_path}/some", [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f"), (3, None)], [(None, 1, 1), (3, None, None)], [(None, "a b c d e f")])
    assert sorted(r.doc_id or -1 for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()) == [-1, 1, 1, 3]
