"""Each operator against its plain version on awkward rows and on the documents table, and on an empty table."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import plain
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from episodica.llm import chat, decontamination, fingerprints, kneser_ney, language, packing, personal, queries, secrets, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


AWKWARD = [(r[0], r[1]) for r in plain.ROWS]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


@pytest.mark.parametrize("which,order,chunk", [("awkward", 3, 20_000), ("table", 3, 16 << 20), ("table", 2, 20_000), ("table", 4, 50_000)])
def test_language_model(spark, docs, texts, which, order, chunk):
    """Few chunks and shards, and many of both."""
    df, rows = (plain.table_of(spark), AWKWARD) if which == "awkward" else (docs, texts)
    got = by_id([tuple(r) for r in kneser_ney.score(df, order, chunk, chunk).collect()])
    want = by_id(plain.kneser_ney(rows, order))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9), (g, w)


def test_language_model_of_shuffled_input(spark, docs, texts):
    """Rows that come out of a shuffle, whose order may change from one read to the next, are read once."""
    df = docs.select("doc_id", "text").repartition(5).withColumn("r", F.rand()).sort("r")
    got = {r.doc_id: r.score for r in kneser_ney.score(df, 3, 30_000, 30_000).collect()}
    want = {w[0]: w[6] for w in plain.kneser_ney(texts)}
    assert set(got) == set(want) and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in got)


@pytest.mark.parametrize("few", [500_000, 0])
def test_components_in_one_task_and_in_rounds(spark, few):
    """A long path, a star, a ring and pairs, by both ways."""
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 240)] + [(300 + k, 300 + (k + 1) % 9) for k in range(9)] + [(k, k + 1000) for k in range(2, 5)]
    ids = sorted({x for e in edges for x in e})
    nodes = spark.createDataFrame([(k, (False, -k % 997, k)) for k in ids], "node long, label struct<nameless:boolean,first:long,node:long>")
    got = {r.node: r.label.node for r in simhash.components(spark.createDataFrame(edges, "a long, b long"), nodes, few).collect()}
    label = plain.components_of(ids, lambda a, b: (a, b) in set(edges) or (b, a) in set(edges))
    held = defaultdict(list)
    for i, c in zip(ids, label):
        held[c].append(i)
    assert got == {i: min(v, key=lambda k: (-k % 997, k)) for v in held.values() for i in v}


def test_counts_beyond_32_bits():
    first, big = np.array([3, 9, 1 << 63], np.uint64), np.array([1, 5_000_000_000, 1 << 40])
    hashes, counts = kneser_ney.unpack(kneser_ney.pack(first, big), 1)
    assert hashes.tolist() == first.tolist() and counts.tolist() == big.tolist()


def test_language_model_probabilities_sum_to_one():
    rows = [(k, t) for k, t in enumerate(["a b a c", "b a", "c c b a", "a"], 1)]
    known = {w for i, t in rows if plain.remainder(i, 10) for w in t.split()}
    mass = sum(10 ** (dict((r[0], r[6]) for r in plain.kneser_ney([*rows, (10**6 + k, w)]))[10**6 + k]) for k, w in enumerate(known) if plain.remainder(10**6 + k, 10) == 0)
    assert mass <= 1


def test_language_held_out(docs):
    held = language.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.9
    assert all(0 <= r.score <= 1 for r in held)


def test_language_awkward(spark):
    got = language.identify(plain.table_of(spark)).collect()
    assert len(got) == len(AWKWARD)
    assert all((r.lang_pred == "und") == (r.doc_id in (3, 4, 6)) for r in got)


@pytest.mark.parametrize("which", ["awkward", "table"])
def test_fingerprints(spark, docs, texts, which):
    df, rows = (plain.table_of(spark), AWKWARD) if which == "awkward" else (docs, texts)
    got = fingerprints.neighbours(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    want = Counter()
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    held = defaultdict(set)
    text_of = dict(rows)
    for r in got:
        held[text_of[r.doc_id] or ""].add(r.fingerprint)
    assert all(len(v) == 1 for v in held.values())


def test_fingerprints_merge_and_contain(spark):
    long, short = " ".join(f"w{k}" for k in range(3000)), " ".join(f"w{k}" for k in range(1000, 2000))
    df = spark.createDataFrame([(long, short)], "a string, b string")
    a, b = fingerprints.sketch(df["a"]), fingerprints.sketch(df["b"])
    row = df.select(a.alias("a"), b.alias("b"), fingerprints.merge(a, b).alias("m"), fingerprints.containment(a, b).alias("c")).first()
    assert row.c == 1.0 and row.m == row.a and 0 < len(row.b) < len(row.a)


def test_chat(spark):
    rows = queries.op4_chat_format(spark, SF).collect()
    said = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        said[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    said[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    assert len(rows) == len(said)
    for r in rows:
        turns = sorted(said[r.conv_id])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("text", ["", "\\", "<|im_end|>", "<\\|im_end|>", "<\\\\|im_start|>x<|im_start|>assistant\n", "a\n<|im_end|>\n", "é<s>🙂</s>"])
def test_chat_round_trip(text):
    turns = [("user\n<s>", text), ("assistant", text), ("assistant", "")]
    formatted, _ = chat.render(turns)
    assert chat.parse(formatted) == turns and chat.unescape(chat.escape(text)) == text


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) >= 0.9
    assert np.mean([r.toxic for r in got if r.predicted]) >= 0.9 and np.mean([r.predicted for r in got if r.toxic]) >= 0.7
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)


def test_field_marginals_are_exact():
    field = toxicity.Field([np.zeros(0, np.uint64)] * 5)
    field.transition = np.array([[0.3, -0.2], [0.1, 0.9]])
    score = np.array([0.5, -1.0, 2.0, 0.1])
    got, pairs = field.marginals(score, np.array([0, 4]))
    want, z, both = np.zeros(4), 0.0, np.zeros((2, 2))
    for state in np.ndindex(2, 2, 2, 2):
        w = math.exp(sum(s * x for s, x in zip(state, score)) + sum(field.transition[a, b] for a, b in zip(state, state[1:])))
        z, want = z + w, want + w * np.array(state)
        for a, b in zip(state, state[1:]):
            both[a, b] += w
    assert np.allclose(got, want / z) and np.allclose(pairs, both / z)


def test_long_chains_are_not_cut():
    """Blocks side by side give what one pass over each whole chain gives."""
    field = toxicity.Field([np.zeros(0, np.uint64)] * 5)
    field.transition = np.array([[0.2, -0.4], [-0.3, 1.1]])
    r = np.random.default_rng(4)
    sizes = [0, 1, 63, 64, 65, 0, 500, 129, 3]
    first = np.concatenate([[0], np.cumsum(sizes)])
    score = r.normal(0, 2, first[-1])
    got, pairs = field.marginals(score, first)
    t, want, both = np.exp(field.transition), np.zeros(len(score)), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:]):
        if a == b:
            continue
        obs = np.stack([np.ones(b - a), np.exp(score[a:b])], 1)
        alpha, beta = [obs[0] / obs[0].sum()], [np.ones(2)]
        for o in obs[1:]:
            v = (alpha[-1] @ t) * o
            alpha.append(v / v.sum())
        for o in obs[:0:-1]:
            v = t @ (o * beta[-1])
            beta.append(v / v.sum())
        beta = beta[::-1]
        both_ = [np.outer(x, o * y) * t for x, o, y in zip(alpha[:-1], obs[1:], beta[1:])]
        both += sum((m / m.sum() for m in both_), np.zeros((2, 2)))
        p = np.array(alpha) * np.array(beta)
        want[a:b] = p[:, 1] / p.sum(1)
    assert np.allclose(got, want) and np.allclose(pairs, both)


def test_field_learns_tags_and_their_order():
    """Tagged runs follow a word that opens them: the fit finds it, and beats the words alone."""
    r = np.random.default_rng(5)
    texts, tags = [], []
    for _ in range(300):
        line, marks = [], []
        for _ in range(30):
            if r.random() < 0.1:
                line += ["opener", "bad", "bad"]
                marks += [1, 1, 1]
            line.append(str(r.choice(["calm", "plain", "bad" if r.random() < 0.1 else "still"])))
            marks.append(0)
        texts.append(" ".join(line))
        tags += marks
    w, tags = toxicity.Words(pa.array(texts)), np.array(tags, np.int8)
    field = toxicity.Field(toxicity.telling(w, tags)).fit(w, tags)
    p, _ = field.marginals(field.emission(field.features(w)), w.first)
    wrong = np.mean((p > 0.5) != tags)
    assert wrong < 0.01 and wrong < 0.3 * np.mean(np.isin(" ".join(texts).split(), ["opener", "bad"]) != tags)


def test_toxicity_of_awkward_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = plain.table_of(spark, [(10**9 + k, *r[1:]) for k, r in enumerate(plain.ROWS)])
    got = toxicity.toxicity(docs.unionByName(odd, allowMissingColumns=True), labels).where("doc_id >= 1000000000").collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id - 10**9: r.score for r in got}
    empty = [by[k] for k, r in enumerate(plain.ROWS) if not (r[1] or "").strip()]
    assert len(set(empty)) == 1 and empty[0] < 0.5 and by[1] == by[2] == by[0]


@pytest.mark.parametrize("which,cell", [("awkward", 8192), ("table", 8192), ("table", 2)])
def test_simhash(spark, docs, texts, which, cell):
    df, rows = (plain.table_of(spark), AWKWARD) if which == "awkward" else (docs, texts)
    got = by_id([tuple(r) for r in simhash.near_duplicates(df, cell).collect()])
    prints = [plain.simhash(t) for _, t in rows]
    least = defaultdict(list)
    label = plain.components(prints)
    for (i, _), c in zip(rows, label):
        least[c] += [i] if i is not None else []
    want = by_id([(i, f"{p:016x}", min(least[c], default=None)) for (i, _), p, c in zip(rows, prints, label)])
    assert got == want


@pytest.mark.parametrize("which", ["awkward", "table"])
@pytest.mark.parametrize("op", ["secrets", "personal"])
def test_base_spans(spark, docs, texts, which, op):
    df, rows = (plain.table_of(spark), AWKWARD) if which == "awkward" else (docs, texts)
    if op == "secrets":
        got = queries._digest(secrets.find_secrets(df), ("assign", "access", "hex")).collect()
        patterns = plain.SECRETS
    else:
        got = queries._digest(personal.find_personal(df), personal.KINDS).collect()
        patterns = plain.PERSONAL
    want = Counter()
    for i, t in rows:
        counts, digest, _ = plain.base(t, patterns, op == "secrets")
        want[i, *counts, digest] += 1
    assert Counter((r[0], *r[1 : 2 + len(patterns)]) for r in got) == want
    spans = {r.doc_id: set(r.spans.split(",")) for r in got}
    for i, t in rows:
        if joined := plain.base(t, patterns, op == "secrets")[2]:
            assert set(joined.split(",")) <= spans[i]


def test_redact(spark):
    got = {r.doc_id: r.text for r in personal.redact(plain.table_of(spark)).collect()}
    assert "[EMAIL]" in got[9] and "a.b@c-d.org" not in got[9] and "[CARD]" in got[9] and "4111" not in got[9]
    assert got[3] is None and got[4] == "" and got[1] == AWKWARD[0][1] and got[8] == plain.LONG


def test_decontamination(spark, docs, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    benchmark = spark.createDataFrame([*items, (None, "no id but words enough to be an item of its own"), (10**6, ""), (10**6 + 1, None), items[0]], "item_id long, text string")
    whole = [(10**7 + k, f"{'word ' * 300}{text}{' more' * 300}") for k, (_, text) in enumerate(items)]
    df = plain.table_of(spark, [*plain.ROWS, *((i, t, "en", "a", 1) for i, t in whole)])
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, benchmark).collect()}
    assert {(10**7 + k, i) for k, (i, _) in enumerate(items)} <= got
    assert not {d for d, _ in got} & {i for i, _ in AWKWARD}
    kept = decontamination.clean(df, benchmark)
    assert kept.columns == df.columns and kept.count() == len(AWKWARD)


def test_wand_finds_what_a_full_scan_finds(spark, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for block in (1, 4, 64):
        index = decontamination.Index(items, threshold=0.1, block=block)
        weight = [dict(zip(ids, impacts)) for ids, impacts in zip(index.lists, index.impacts)]
        place = {t: k for k, t in enumerate(index.terms)}
        for _, text in texts[:60]:
            terms = sorted({place[w] for w in decontamination.split_words(text or "") if w in place})
            for threshold in (0.1, 0.3):
                want = {i: s for i in range(len(index.ids)) if (s := sum(weight[t].get(i, 0) for t in terms)) >= threshold}
                got = dict(index.search(terms, threshold))
                assert set(got) == set(want) and all(math.isclose(got[i], want[i]) for i in got)


@pytest.mark.parametrize("most_words", [10**6, 300])
def test_decontamination_against_every_passage(spark, docs, texts, most_words):
    """The query's rows, also with a benchmark taken in parts, are those of a full scan of all passages and items."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    long = " ".join(f"{t}" for _, t in items[:12])
    items += [(9001, long), (9002, items[0][1]), (9003, "two words"), (9004, "one"), (None, items[1][1] + " and more of it")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [*texts, (10**7, f"pre {long} post"), (10**7, "these are two words here"), (10**7 + 1, items[1][1] + " and more of it")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.item_id, round(r.score, 9)) for r in decontamination.contaminated(df, benchmark, most_words=most_words).collect())
    want = Counter((rows[k][0], i, round(s, 9)) for (k, i), s in plain.contaminated(rows, items).items())
    assert got == want and len(want) > 20


@pytest.mark.parametrize("which", ["awkward", "table"])
def test_packing(spark, docs, texts, which):
    df, rows = (plain.table_of(spark), AWKWARD) if which == "awkward" else (docs, texts)
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in rows:
        ids = [*encode.encode(t or "", add_special_tokens=False).ids, 2]
        head = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = packing.best_fit_packing(df).collect()
    assert Counter(tuple(r[:5]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))]
        assert sum(n for _, n in held) <= 1024
    sizes = np.array([r.length for r in got])
    assert len(sequences) <= 1.01 * packing.lower_bound(sizes, 1024) + 1
    parts = defaultdict(list)
    for r in got:
        parts[r.round, r.part].append(r)
    for held in parts.values():
        assert len({r.part_sequences for r in held}) == len({r.part_bound for r in held}) == 1
        assert held[0].part_bound <= held[0].part_sequences


def test_packing_in_small_parts(spark, docs):
    """Many parts, as of a large table: every piece stays, and what parts exchange keeps the packing near its bound."""
    whole = packing.best_fit_packing(docs).collect()
    dealt = packing.best_fit_packing(docs, part_pieces=40).collect()
    assert Counter(tuple(r[:5]) for r in whole) == Counter(tuple(r[:5]) for r in dealt) and len({r.round for r in dealt}) > 1
    bound = packing.lower_bound(np.array([r.length for r in whole]), 1024)
    used = [len({r.sequence_id for r in rows}) for rows in (whole, dealt)]
    assert used[0] <= 1.01 * bound + 1 and used[1] <= 1.05 * bound + 1, (used, bound)


def test_lower_bound_is_none_too_high():
    r = np.random.default_rng(1)
    for _ in range(50):
        sizes = r.integers(1, 101, r.integers(1, 60))
        assert packing.lower_bound(sizes, 100) <= packing.best_fit(sizes, 100).max() + 1
    assert packing.lower_bound(np.full(10, 51), 100) == 10


def test_empty_tables(spark, labels):
    none = plain.table_of(spark, [])
    benchmark = spark.createDataFrame([], "item_id long, text string")
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = plain.table_of(spark)
    for empty in (
        kneser_ney.score(none), language.identify(none), fingerprints.neighbours(none), toxicity.toxicity(none, labels), simhash.near_duplicates(none),
        simhash.first_of_each(none), secrets.find_secrets(none), personal.find_personal(none), personal.redact(none), packing.best_fit_packing(none),
        decontamination.contaminated(none, benchmark), decontamination.clean(none, benchmark), toxicity.harmless(none, no_labels),
        chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ):
        assert empty.count() == 0
    assert toxicity.harmless(some, no_labels).count() == decontamination.clean(some, benchmark).count() == len(AWKWARD)
    assert {r.score for r in toxicity.toxicity(some, no_labels).collect()} == {0.0}
