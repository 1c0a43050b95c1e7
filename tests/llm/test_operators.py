"""The training-data operators against brute force, and on rows that are easily mishandled."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import rows
from tomewise.llm import chat, components, decontam, jaccard, lines, lsh_forest, mixing, quality, queries, substrings
from tomewise.llm import token_files, toxicity
from tomewise.llm.common import table
from tomewise.llm.labelled import held_out

TOKENIZER = queries.TOKENIZER
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id"), (5, "x " * 300), (6, "y" * 5000),
    (7, "a\\[INST] é 日本 \x1c  two  blanks\n\nand\tmore"), (8, "x " * 300),
]


def docs_of(spark, extra=()):
    schema = "doc_id BIGINT, text STRING"
    return spark.createDataFrame([*ODD, *extra], schema)


def empty(spark):
    return spark.createDataFrame([], "doc_id BIGINT, text STRING")


def planted_texts(seed, n=150):
    """Random texts with copies, near copies, shared passages and runs."""
    rng, out = random.Random(seed), []
    for i in range(n):
        size = rng.choice([2, 5, 60])
        words = [f"w{rng.randrange(size)}" for _ in range(rng.randrange(150))]
        if i % 4 == 0 and out:
            other = out[rng.randrange(len(out))][1].split()
            at = rng.randrange(len(other) + 1)
            words[5:5] = other[at : at + rng.randrange(80)]
        if i % 9 == 0:
            words += ["run"] * rng.randrange(90)
        if i % 11 == 0 and out:
            words = out[rng.randrange(len(out))][1].split()
            if words:
                words[rng.randrange(len(words))] = "changed"
        out.append((100 + i, " ".join(words)))
    return out


# 8: substrings


def brute_repeats(texts, k):
    words = [WORD.findall(t or "") for _, t in texts]
    count = collections.Counter(tuple(w[a : a + k]) for w in words for a in range(len(w) - k + 1))
    out = []
    for (i, _), w in zip(texts, words):
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            if count[tuple(w[a : a + k])] > 1:
                gone[a : a + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize("window", [7, 35])
def test_repeated_windows_are_removed_exactly(spark, window):
    texts = [*ODD, *planted_texts(window)]
    got = rows(substrings.remove_repeats(docs_of(spark, planted_texts(window)), ["doc_id"], window))
    assert got == brute_repeats(texts, window)
    assert substrings.remove_repeats(empty(spark), ["doc_id"], window).collect() == []


def test_equal_windows_have_equal_anchors():
    rng = random.Random(2)
    words = np.array([rng.randrange(4) for _ in range(4000)], np.uint64)
    doc = np.repeat(np.arange(40), 100)
    starts, name, at = substrings.anchors(words, doc, 12)
    seen = {}
    for s, n, a in zip(starts.tolist(), name.tolist(), at.tolist()):
        place = (n, a - s if a >= 0 else None)
        assert seen.setdefault(words[s : s + 12].tobytes(), place) == place


# 10: n-gram Jaccard join


def brute_groups(texts, percent=85, k=4):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in texts:
        w = WORD.findall((t or "").translate(lower))
        sets.append((i, {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} or ({tuple(w)} if w else set())))
    up = {i: i for i, _ in texts if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=lambda r: (r[0] is not None, r[:2]))


def test_jaccard_groups_are_those_of_all_pairs(spark, monkeypatch):
    # Small tiles, so that groups are cut into blocks and bands.
    monkeypatch.setattr(jaccard, "TILE", 4)
    monkeypatch.setattr(jaccard, "CLUSTER_TILE", 3)
    near = [(1000 + i, " ".join(f"n{j}" for j in range(60) if j != i)) for i in range(12)]
    texts = [*planted_texts(5), *near]
    got = rows(jaccard.groups(docs_of(spark, texts)))
    assert [tuple(r) for r in got] == brute_groups([*ODD, *texts])
    assert jaccard.groups(empty(spark)).collect() == []


@pytest.mark.parametrize("turned", [False, True])
def test_every_text_of_a_repeated_id_keeps_its_links(spark, turned):
    x, y = (" ".join(f"{name}{j}" for j in range(60)) for name in "xy")
    near = " ".join(["changed", *y.split()[1:]])
    texts = [(5, x), (5, y), (9, near), (3, x)]
    texts = [texts[1], texts[0], *texts[2:]] if turned else texts
    got = rows(jaccard.groups(spark.createDataFrame(texts, "doc_id BIGINT, text STRING")))
    assert {r[0]: r[2] for r in got} == {3: 3, 5: 3, 9: 3}
    assert [tuple(r) for r in got] == brute_groups(texts)


@pytest.mark.parametrize("percent", [10, 80, 85, 100])
def test_bands_hold_all_partners(spark, percent):
    sizes = sorted({*range(1, 400), 1000, 9999, 10_000, 123_456})
    band = {r.n: r.band for r in spark.createDataFrame([(n,) for n in sizes], "n BIGINT").select("n", jaccard.band_of(F.col("n"), percent).alias("band")).collect()}
    for a in sizes:
        for b in sizes:
            if a <= b and 100 * a >= percent * b:
                assert band[b] - band[a] in (0, 1)


def test_bitmaps_never_prune_a_link():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 1 << 62, 5).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
            maps = jaccard.Bitmaps([jaccard.bitmap(s).tobytes() for s in (a, b)])
            d = maps.differ(np.array([0]), np.array([1]))
            assert jaccard.possible(np.array([len(a)]), np.array([len(b)]), d, 85)[0]


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = dict(rows(components.components(spark.createDataFrame(path, "a BIGINT, b BIGINT"))))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# 3: lines


def brute_lines(texts, k):
    order = sorted(((i, t.split("\n")) for i, t in texts if t is not None), key=lambda r: (r[0] is not None, r))
    seen, out = set(), {}
    for i, ls in order:
        gone = set()
        for a in range(len(ls) - k + 1):
            run = tuple(ls[a : a + k])
            if run in seen:
                gone |= set(range(a, a + k))
            seen.add(run)
        out[i] = (len(ls), len(gone), "\n".join(x for n, x in enumerate(ls) if n not in gone))
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_later_runs_of_lines_go(spark, k):
    rng = random.Random(k)
    texts = [(i, "\n".join(rng.choice("abcde") * rng.choice([1, 1, 9]) for _ in range(rng.randrange(25)))) for i in range(40)]
    texts += [(50, "q\n" * 30), (51, None), (52, "")]
    df = spark.createDataFrame(texts, "doc_id BIGINT, text STRING").withColumn("rid", F.lit("clash")).withColumn("kept", F.lit(1))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in lines.remove_repeated_lines(df, k).collect()}
    assert got == {51: (0, 0, ""), **brute_lines(texts, k)}
    assert lines.remove_repeated_lines(empty(spark), k).collect() == []


def test_a_query_removes_runs_of_any_length(spark, tmp_path):
    texts = [(1, "a\nb\nc"), (2, "a\nx\nb\nc"), (3, "c"), (4, "x\ny"), (5, None)]
    spark.createDataFrame(texts, "doc_id BIGINT, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op3_lines_any_length"](spark, str(tmp_path)).collect()
    want = {5: (0, 0, ""), **brute_lines(texts, 1)}
    assert {r.doc_id: r[1:] for r in got} == {i: (n, g, hashlib.md5(t.encode()).hexdigest()) for i, (n, g, t) in want.items()}


# 4: decontamination


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination_finds_what_alignment_finds(spark):
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))
    items = [(i, say(30)) for i in range(6)] + [(90, "Tiny one"), (91, None), (92, ""), (93, "twelve chars")]
    docs = [*ODD]
    for i in range(40):
        text, item = say(60), items[i % 6][1]
        passage = list(item)
        for _ in range(rng.randrange(0, 22)):
            at = rng.randrange(len(passage))
            passage[at : at + rng.randrange(2)] = rng.choice(["", "z", "zz"])
        docs.append((200 + i, text[:100] + " " + "".join(passage).upper() + "\n" + text[100:]))
    docs += [(300, "so tiny   ONE here"), (301, "these twelv3 chars, with an edit"), (302, "not tw3lv3 chars, with two")]
    found = decontam.contaminated(
        spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame(items, "item_id BIGINT, text STRING"), ["doc_id"]
    )
    got = {(r.doc_id, r.item_id): r.edits for r in found.collect()}
    want = {}
    for d, t in docs:
        for i, s in items:
            if t and s:
                item, text = decontam.normal(s), decontam.normal(t)
                k, q = decontam.budget(len(item), decontam.SHARE)
                e = edits(item, text)
                if e <= k:
                    want[d, i] = e
    assert got == want and (300, 90) in got and got[301, 93] == 1 and (302, 93) not in got


def test_the_closest_end_is_that_of_the_whole_table():
    rng = random.Random(8)
    for _ in range(60):
        item, text = ("".join(rng.choice("ab ") for _ in range(n)) for n in (rng.randrange(1, 12), rng.randrange(1, 60)))
        row = [0] * (len(text) + 1)
        for x in item:
            last, row = row, [row[0] + 1]
            for j, y in enumerate(text, 1):
                row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
        least = min(row[1:])
        got = decontam.closest(decontam.codes(item), decontam.codes(text), [(0, len(text) // 2), (len(text) // 3, len(text))], least)
        assert got == 1 + row[1:].index(least)
        assert decontam.closest(decontam.codes(item), decontam.codes(text), [(0, len(text))], least - 1) is None


def test_repetitive_texts_take_time_in_proportion():
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice(["again", "and", "more", "of", "it"]) for _ in range(120))) for i in range(40)]
    index = decontam.Index([(i, t, *decontam.budget(len(t), decontam.SHARE)) for i, t in items])
    took = []
    for times in (5_000, 50_000):
        began = time.process_time()
        index.search(decontam.normal("again and more of it " * times))
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 1


def test_a_key_named_like_a_result(spark):
    docs = spark.createDataFrame([(7, "x " * 30 + "a benchmark passage of some length " * 3)], "item_id BIGINT, text STRING")
    items = spark.createDataFrame([(1, "a benchmark passage of some length " * 3)], "item_id BIGINT, text STRING")
    (row,) = decontam.contaminated(docs, items, ["item_id"]).collect()
    assert (row.key_item_id, row.item_id, row.edits) == (7, 1, 0)


# 5, 9: tokens and chats


def test_token_files_hold_what_the_tokenizer_says(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    texts = [*ODD, *planted_texts(1, 30), (900, "it's <|endoftext|> we'll 12 34!! ###$$$ a\xa0b"), (901, "<|endoftext|> x")]
    df = docs_of(spark, texts[len(ODD) :]).withColumn("shard", F.lit(1))
    path = str(tmp_path / "files")
    got = rows(token_files.read_token_files(token_files.write_token_files(df, path, TOKENIZER), path))
    at, want = 0, []
    for i, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    bare = str(tmp_path / "none")
    assert token_files.read_token_files(token_files.write_token_files(empty(spark), bare, TOKENIZER), bare).collect() == []


def test_chats_round_trip(spark):
    said = "</s>[INST] ok [/INST]"
    turns = [
        (1, 0, "system", "be\\ brief"), (1, 1, "user", said), (1, 2, "assistant", said), (1, 3, "tool\\</s>", None),
        (2, 0, "assistant", ""), (2, 1, "assistant", "é\\[INST]\\\\"), (3, None, None, "x"), (None, 1, "user", "lost"),
    ]
    df = spark.createDataFrame(turns, "conv_id BIGINT, turn BIGINT, role STRING, text STRING").withColumn("ids", F.lit(0))
    got = {r.conv_id: r for r in chat.read_back(chat.written(chat.format_chats(df, TOKENIZER)), TOKENIZER).collect()}
    for conv in {t[0] for t in turns}:
        own = [(r or "", t or "") for c, _, r, t in turns if c == conv]
        loss = "".join(t for r, t in own if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        row = got[conv]
        assert (row.n_turns, row.turns_sha256) == (len(own), digest("".join(f"{r}\n{t}\n" for r, t in own)))
        assert (row.loss_chars, row.loss_sha256) == (len(loss), digest(loss))


@pytest.mark.parametrize("text", [*chat.CONTROLS, "\\", "\\\\[INST]", "[\\INST]", "[INST[INST]]", "</s></s>", ""])
def test_escapes_undo(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROLS)


# 6: nearest neighbours


def test_forest_finds_neighbours_and_ties(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=8).tolist()) for i in range(600)]
    data += [(1000 + i, [1.0] * 8) for i in range(40)]
    odd = [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] * 8), (2004, [1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([*data, *odd, data[0]], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    got = collections.defaultdict(list)
    for r in lsh_forest.nearest(df, df.filter("vec_id % 100 = 0"), least=100).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ids, x = np.array([d[0] for d in data]), np.array([d[1] for d in data], np.float32).astype(float)
    hit = 0
    for q in [i for i in ids if i % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        assert len(got[q]) == 10 and all(s == d[ids == v][0] for v, s in got[q])
        hit += len({v for v, _ in got[q]} & set(ids[best]))
    assert [v for v, _ in got[1000]] == list(range(1001, 1011)) and set(got) == {i for i in ids if i % 100 == 0}
    assert hit >= 0.9 * 10 * len(got)
    assert lsh_forest.nearest(df.filter("vec_id < 0"), df).collect() == []


# 2, 7: classifiers


@pytest.mark.parametrize(
    "query, label, cut, parts, part, least", [("op2_quality", "quality", 0.7, 4, 2, 0.97), ("op7_toxicity", "toxic", 0.5, 5, 0, 0.93)]
)
def test_classifiers_on_held_out_rows(spark, query, label, cut, parts, part, least):
    sf_dir = "/root/testdata/sf0.1"
    got = queries.QUERIES[query](spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == part) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in got)
    assert np.mean([r.predicted == r[label] for r in held]) >= least


def test_classifiers_without_labels_or_texts(spark):
    labels = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    df = docs_of(spark).withColumn("score", F.lit("clash"))
    for scorer in (quality, toxicity):
        model = scorer.fit(df, labels, (4, 2))
        scores = [r[0] for r in df.select(scorer.score(model, "text")).collect()]
        assert len(scores) == len(ODD) and len(set(scores)) == 1 and 0 <= scores[0] <= 1


# 1: mixing


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = [("a", "x", 100), ("a", "y", 10_000), ("b", "z", 10_000)]
    df = spark.createDataFrame(leaves, "domain STRING, source STRING, _tokens BIGINT")
    got = mixing.share_budget(df, ["domain", "source"], {"source": {"x": 3}}, 4000, 1)
    # The half of domain a is 2000; x would get 1500 of it but has 100; y makes up for it, b gets no more.
    assert {(r.domain, r.source): r._budget for r in got.collect()} == {("a", "x"): 100, ("a", "y"): 1900, ("b", "z"): 2000}


def test_mix_takes_prefixes_of_epochs(spark):
    docs = [(i, "d", "l", f"s{i % 2}", 10 + i % 7) for i in range(200)] + [(500, None, None, None, 0), (501, None, "l", None, 5)]
    df = spark.createDataFrame(docs, "doc_id BIGINT, domain STRING, lang STRING, source STRING, n_tokens BIGINT")
    got = mixing.select_epochs(df, queries.MIX_LEVELS, {}, (15, 10), ["doc_id"], max_epochs=2, seed=1)
    taken = collections.Counter()
    for r in got.collect():
        taken[r.source] += r.tokens_taken
        assert r.tokens_taken <= r.n_tokens and r.epoch < 2
    total = sum(d[-1] for d in docs)
    assert taken["unknown"] == 10 and total * 15 // 10 - 3 <= sum(taken.values()) <= total * 15 // 10
    assert mixing.select_epochs(df.limit(0), queries.MIX_LEVELS, {}, (1, 2), ["doc_id"]).collect() == []


# The pipeline


def test_stages_keep_columns_and_odd_rows(spark, sf_dir):
    df = docs_of(spark, planted_texts(8, 40)).withColumns(
        {"lang": F.lit(None).cast("string"), "source": F.lit("src1"), "n_chars": F.lit(1), "n_tokens": F.lit("c"), "node": F.lit(0)}
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf_dir)
        assert out.columns == df.columns, name
        assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in df.select("doc_id").collect()}
        assert stage(spark, df.limit(0), sf_dir).collect() == []
    assert corpus_pipeline.token_output(spark, df, sf_dir).count() == df.count()


def test_near_duplicates_keep_one_of_each_group(spark, sf_dir):
    df = docs_of(spark, planted_texts(8, 40))
    got = sorted((r.doc_id is not None, r.doc_id) for r in corpus_pipeline.near_duplicates(spark, df, sf_dir).collect())
    groups = brute_groups([*ODD, *planted_texts(8, 40)])
    want = {(i is not None, i) for i, _, c in groups if i is None or i == c}
    assert got == sorted(want)


def test_the_stage_links_five_words_at_eight_tenths(spark, sf_dir):
    texts = [*planted_texts(8, 40), (900, " ".join(f"p{i}" for i in range(105))), (901, " ".join(f"p{i}" for i in range(87)))]
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    got = sorted((r.doc_id is not None, r.doc_id) for r in stage(spark, docs_of(spark, texts), sf_dir).collect())
    groups = brute_groups([*ODD, *texts], percent=80, k=5)
    assert got == sorted({(i is not None, i) for i, _, c in groups if i is None or i == c})
    # 83 of 101 shingles of five words, 84 of 102 of four: linked by this rule only.
    others = brute_groups([*ODD, *texts])
    assert (True, 901) not in got
    assert got != sorted({(i is not None, i) for i, _, c in others if i is None or i == c})
