"""The operators of quayside.llm against brute force, on small made-up rows and on the smallest tables."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quayside.llm import html, jaccard, mixing, mixture_lm, packing, quality, substrings, tokens, topk, toxicity
from quayside.llm import registry
from quayside.llm.common import table
from tests.conftest import FOLDER

ODD = "doc_id long, text string, kept string, toxicity string, n string, k string"
VOCABULARY = [a + b for a in "kalomintrase" for b in ["an", "el", "or", "ith", "un"]]


def text_of(seed, words):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(words))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with clashing names."""
    base = text_of(1, 120)
    rows = [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \n\t"), (None, base + " x"), (6, text_of(2, 20_000)), (7, "one two"), (7, "one two"), (8, base + " tail"), (9, text_of(3, 60) + " " + base)]
    return spark.createDataFrame([(i, t, None, "x", None, "y") for i, t in rows], ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


@pytest.mark.parametrize("name", sorted(registry.load_all()["sql"]))
def test_sql(spark, name):
    from tools.compare import compare, duck

    found = registry.load_all()
    ok, message = compare(spark, duck(FOLDER), FOLDER, name, found["queries"][name], found["sql"][name])
    assert ok, message


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            parent[top(i)] = top(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(rows[i][0])
    return sorted((rows[i][0], len(sets[i]), min(groups[top(i)])) for i in range(len(rows)))


def test_jaccard_chain_of_near_copies(spark):
    words = text_of(5, 300).split()
    rows = [(0, " ".join(words))]
    for k in range(1, 40):  # every copy differs from the one before, the first and last share little
        words = list(words)
        words[(7 * k) % 300] = f"new{k}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, text_of(k, 80)) for k in range(20)] + [(200, None), (201, ""), (202, "a b"), (203, "A  b")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute_components(rows)


def test_tree_bound_loses_no_link():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool[k % 3 * 150 : k % 3 * 150 + 180], rng.integers(100, 170), replace=False)) for k in range(60)]
    keys, sizes = np.arange(60), np.array([len(s) for s in sets])
    found = jaccard.bounded_pairs(keys, sizes, keys, [jaccard.read_vector(jaccard.count_vector(s), len(s)) for s in sets], np.zeros(60))
    for i, j in itertools.combinations(range(60), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            assert (i, j) in found


def test_odd_rows_and_empty_tables(spark, odd, empty):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.jaccard_components(odd).collect()}
    assert got[2, 116] == 1 and got[8, 117] == 1 and got[3, 0] == 3 and got[7, 1] == 7
    assert sorted(r.doc_id for r in jaccard.one_per_group(odd).collect() if r.doc_id is not None)[:5] == [1, 3, 4, 5, 6]
    assert jaccard.jaccard_components(empty).count() == 0

    measures = ["n_words", "n_repeat_words"]
    judged = quality.apply_cascade(odd, quality.plan_cascade(odd, quality.RULES), measures)
    assert judged.count() == len(docs) and "toxicity" in judged.columns
    assert quality.apply_cascade(empty, quality.plan_cascade(empty, quality.RULES), measures).count() == 0

    counted = tokens.counted(odd, tokens.default_model())
    assert {r.n_tokens for r in counted.collect() if r.doc_id in (3, 4, 5)} == {0}
    assert toxicity.score(empty, None).count() == 0 and toxicity.score(odd, None).count() == len(docs)

    spans = substrings.find_passages(odd).collect()
    assert {(s.doc_id, s.first_doc_id) for s in spans if s.doc_id == 9} and substrings.find_passages(empty).count() == 0
    cut = substrings.without_passages(odd)
    assert cut.columns == odd.columns and cut.where("doc_id = 9").head().text == text_of(3, 60)

    pieces = packing.pack_documents(odd.select("doc_id", "text"), packing.default_tokenizer()).collect()
    assert sum(p.length for p in pieces if p.doc_id == 3) == 1 and packing.pack_documents(empty, packing.default_tokenizer()).count() == 0

    scored = mixture_lm.score_documents(odd, odd.where("doc_id < 7")).collect()
    assert len(scored) == len(docs) and all(s.score < 0 for s in scored)
    assert mixture_lm.score_documents(empty, empty).count() == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rows = [(k, text_of(k, 3 ** (k % 8)) + " it's 12 naïve!! ÀÉ ß <|endoftext|> ́x") for k in range(60)] + [(60, None)]
    pieces = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), path, width=512, group_docs=20).collect()
    for doc, text in rows:
        own = sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start)
        assert np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 512 and ends & (ends - 1) == 0


def test_token_counts_equal_a_unigram_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = tokens.vocabulary(tokens.default_model())
    reference = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    reference.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(replacement=tokens.MARK, prepend_scheme="always", split=True)])
    texts = [r.text for r in table(spark, FOLDER, "documents").collect()] + ["", "☃☃☃ a☃b 日本語", "  x  ", "▁a b", "▁▁ab", "a\x1cb", "the\x1fend x", "a▁b ▁", "x\x85y\xa0z"]
    assert tokens.Counter(pieces).counts(texts) == [len(reference.encode(t, add_special_tokens=False).ids) for t in texts]


def test_language_model_is_proper():
    """The probabilities of all next bits sum to one: each path of the code has one probability, and codes are complete."""
    coder = mixture_lm.build_coder([(k * 7919 + 1, 50 - k) for k in range(40)], 9, 30)
    assert sum(2.0 ** -int(n) for n in coder.length) == pytest.approx(1.0)
    paths = {tuple(coder.bits[f : f + n]) for f, n in zip(coder.first, coder.length)}
    assert len(paths) == 42


def test_base_score(spark):
    rows = [(k, text_of(k, 40)) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scored = {r.doc_id: r for r in mixture_lm.score_documents(docs, docs.where("doc_id % 3 <> 0")).collect()}
    count = Counter()
    for k, t in rows:
        if k % 3:
            count.update([*t.split(), None])
    total, distinct = sum(count.values()), len(count)
    for k, t in rows:
        expected = sum(np.log10((count[w] + 1) / (total + distinct + 1)) for w in [*t.split(), None])
        assert scored[k].base_score == pytest.approx(expected) and scored[k].train_tokens == total
        assert scored[k].n_known == sum(count[w] > 0 for w in [*t.split(), None])


def test_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        return new

    terms = ["moron", "stupid", "scum"]
    machine = toxicity.build_automaton([(t, False) for t in terms])
    rng = random.Random(2)
    words = {"".join(rng.choice("morncstupid") for _ in range(rng.randint(3, 7))) for _ in range(2_000)}
    words |= {t[:i] + c + t[i + k :] for t in terms for i in range(len(t)) for c in ["", "x", "m"] for k in (0, 1)}
    for word in words:
        near = [t for t in terms if distance(word, t) <= (1 if len(t) >= 5 else 0)]
        points, _ = toxicity.letters_of([word])
        assert bool(machine.hits(points)) == bool(near), word


def test_toxic_documents_are_found(spark):
    rows, labels = [], []
    for k in range(200):
        bad = k % 4 == 0
        rows.append((k, text_of(k, 50) + (" you filthy gronk" if bad else " you fine friend") + f" {text_of(k + 999, 20)}"))
        labels.append((k, int(bad)))
    rows += [(900, text_of(900, 40) + " you filthy gronkk"), (901, 'they said "gronk" is a word'), (902, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    score = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    assert all((score[k] >= 0.3) == (k % 4 == 0) for k in range(200)) and score[902] < 0.3


def test_html_roles_and_blocks():
    def page(k):
        return f"<html><head><title>t{k}</title><style>p{{}}</style></head><body><nav><ul>{'<li><a>m</a></li>' * (2 + k % 3)}</ul></nav><article><h1>Head {k}</h1><p>A &amp; b\n {k}<p>second  {k}</p>{'<p>more</p>' * (k % 2)}</article><div class='comments'><p>c{k}</p></div><footer>f</footer>"

    wrapper = None
    for k in range(8):
        wrapper = html.merge(wrapper, 1, html.page_nodes(page(k)))
    main = html.roles(wrapper[1])
    for k in range(8):
        got = html.extract(page(k), wrapper[1], main, {})
        assert got.split("\n")[:3] == [f"Head {k}", f"A & b {k}", f"second {k}"] and "m" not in got.split("\n") and f"c{k}" not in got
    assert html.extract(None, wrapper[1], main, {}) == "" and html.extract("", None, [], {}) == ""


def test_water_filling():
    targets = [a / b for a, b in mixing.water_fill([10, 1000, 10, 0], [1, 2, 3, 1], 3)]
    assert sum(targets) == pytest.approx(1020) and targets[0] == 30 and targets[2] == 30 and targets[3] == 0


def test_top_k_with_ties_and_odd_vectors(spark):
    rows = [(0, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [-1.0, -1.0]), (7, [0.25])]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.top_k(vectors.where("vec_id = 0"), vectors, k=3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 512 * 1024), (2, 512 * 1024), (7, 512 * 256)]


def test_passages_against_brute_force(spark):
    common = text_of(77, 70)
    rows = [(k, text_of(k, 90) + " " + (common if k % 5 == 0 else text_of(k + 500, 70)) + " " + text_of(k + 1000, 30)) for k in range(30)]
    got = substrings.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.first_doc_id, r.start) for r in got} == {(k, 0, 90) for k in range(5, 30, 5)}
    assert all(66 <= r.n_words <= 74 for r in got)


def test_edited_passages_are_all_found(spark):
    """Near copies at and above a similarity of 0.75: 50 to 80 words with one, two or three changed words."""
    rng = random.Random(4)
    rows, expected = [], set()
    for k in range(240):
        words, changes = [(52, 1), (60, 1), (75, 2), (80, 2), (50, 1), (80, 3)][k % 6]
        passage = text_of(10_000 + k, words).split()
        while True:
            edited = list(passage)
            for at in rng.sample(range(words), changes):
                edited[at] = f"edit{k}x{at}"
            same = [all(edited[i + j] == passage[i + j] for j in range(5)) for i in range(words - 4)]
            last = len(same) - 1 - same[::-1].index(True)
            size = last - same.index(True) + 1
            if size >= substrings.WIDTH and 7 * sum(same) >= 6 * size:
                break
            changes = max(changes - 1, 0)
        rows.append((k, f"{text_of(k + 20_000, 60)} {' '.join(passage)} {text_of(k + 30_000, 60)}"))
        rows.append((1_000 + k, f"{text_of(k + 40_000, 70)} {' '.join(edited)} {text_of(k + 50_000, 50)}"))
        expected.add((1_000 + k, k, 70 + same.index(True)))
    got = substrings.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.first_doc_id, r.start) for r in got} == expected


def test_passages_are_all_runs_that_hold_six_sevenths():
    assert substrings.passages(np.r_[0:42, 54:96]) == [(0, 95)]  # eight neighbouring words of 100 replaced
    runs = substrings.passages(np.r_[np.delete(np.arange(51), range(20, 25)), 61, 72, 83])  # a near copy, then stray places
    assert len(runs) == 1 and runs[0][0] == 0 and runs[0][1] in (50, 61)
    rng = random.Random(6)
    for _ in range(400):
        dense = [rng.choice((0.2, 0.8, 0.86, 0.95, 1)) for _ in range(5)]
        at = [p for p in range(250) if rng.random() < dense[p // 50]]
        valid = [(a, b) for i, a in enumerate(at) for j, b in enumerate(at[i:], 1) if b - a + 1 >= substrings.WIDTH and 7 * j >= 6 * (b - a + 1)]
        got = substrings.passages(np.array(at, dtype=np.int64))
        assert set(got) <= set(valid) and got == sorted(got)
        assert {p for a, b in got for p in at if a <= p <= b} == {p for a, b in valid for p in at if a <= p <= b}
        assert all(not (c <= a and b <= d) for a, b in got for c, d in valid if (a, b) != (c, d))
        assert all(x[1] < z[0] for x, z in zip(got, got[2:]))


def test_null_and_repeated_ids_keep_their_texts(spark):
    """A third of the rows without an id, two texts under one id, copies and null texts: nothing but near copies goes."""
    rows = [(None if k % 3 == 0 else k // 2 if k % 3 == 1 else k, text_of(k, 60)) for k in range(90)]
    copies = [(None, rows[0][1]), (None, rows[3][1] + " tail"), (500, rows[6][1]), (500, None), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows + copies], "doc_id long, text string, source string")
    kept = jaccard.one_per_group(docs)
    got = Counter((r.doc_id, r.text or "") for r in kept.collect())
    expected = Counter(rows + [(500, rows[6][1]), (500, ""), (None, "")])
    del expected[None, rows[6][1]]  # a copy with an id comes first
    tails = {(None, rows[3][1]), (None, rows[3][1] + " tail")}
    assert sum(got[t] for t in tails) == 1
    assert {t: n for t, n in got.items() if t not in tails} == {t: n for t, n in expected.items() if t not in tails}

    many = spark.createDataFrame([(None, text_of(k, 30), "ab"[k % 2]) for k in range(200)] + [(None, "x y", "a")] * 20, docs.schema)
    pieces = packing.pack_documents(many, packing.default_tokenizer(), group_docs=20).collect()
    assert len({p.sequence_id >> 32 for p in pieces}) > 5
    taken = Counter(r.text for r in mixing.mixed(many).where("source = 'a'").collect())
    assert len(taken) > 20 and 0 < sum(n * len(t.split()) for t, n in taken.items()) < 3040  # part of the source, not all or nothing


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, FOLDER, "documents")
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
    assert all(zlib.crc32(b"") <= r.ids_crc32 < 1 << 32 for r in rows)


def test_packing_leaves_no_padding():
    import random

    draw = random.Random(1)
    for _ in range(500):
        width = draw.choice([8, 64, 512])
        lengths = sorted((draw.randint(1, draw.choice([3, width, 3 * width])) for _ in range(draw.randint(0, 40))), reverse=True)
        sequences = packing.pack(lengths, width)
        sizes = [sum(n for _, _, n in pieces) for pieces in sequences]
        assert all(s == width or s & (s - 1) == 0 for s in sizes) and sum(s < width for s in sizes) <= width.bit_length()
        covered = sorted((doc, start, n) for pieces in sequences for doc, start, n in pieces)
        ends = {}
        for doc, start, n in covered:
            assert n > 0 and start == ends.get(doc, 0)
            ends[doc] = start + n
        assert ends == dict(enumerate(lengths))


def test_compact_windows_group_every_run_by_its_smallest_token():
    rng = random.Random(9)
    for _ in range(30):
        texts = [np.array([rng.randrange(rng.choice([5, 1 << 60])) for _ in range(rng.randint(0, 40))], dtype=np.uint64) for _ in range(5)]
        width = rng.randint(2, 9)
        windows = substrings.compact_windows(texts, width)
        for f in (0, 3):
            mine = windows[windows["f"] == f]
            for c, tokens in enumerate(texts):
                values = substrings.mix64(tokens + substrings.SEEDS[f]).tolist()
                for i in range(len(tokens)):
                    for j in range(i + width - 1, len(tokens)):
                        smallest = min(values[i : j + 1])
                        held = [w for w in mine if w["c"] == c and w["l"] <= i and j <= w["r"] and int(w["v"]) == smallest]
                        assert len(held) >= 1
                own = [w for w in mine if w["c"] == c]
                assert all(min(values[w["l"] : w["r"] + 1]) == int(w["v"]) and w["r"] - w["l"] + 1 >= width for w in own)
        if width > 2:
            assert len(windows) <= substrings.HASHES * sum(max(0, len(t) - width + 1) for t in texts)


def test_covered_counts_functions_once():
    at = lambda *w: (*(np.array(x, dtype=np.int64) for x in zip(*w)), 2)
    assert substrings.covered(*at((0, 99, 0), (50, 149, 0))) == []  # one function only
    assert substrings.covered(*at((0, 99, 0), (50, 149, 1))) == [(50, 99)]
    assert substrings.covered(*at((0, 99, 0), (20, 40, 0), (54, 200, 1))) == [(54, 99)]
    assert substrings.covered(*at((0, 99, 0), (55, 200, 1))) == []  # 45 places are too few
    assert substrings.covered(*at((0, 60, 0), (61, 120, 2), (0, 120, 1), (200, 300, 3), (210, 290, 4))) == [(0, 120), (210, 290)]
    assert substrings.covered(*at((0, 99, 0), (0, 99, 1), (0, 99, 2))[:3], 3) == [(0, 99)] and substrings.covered(*at((0, 99, 0), (0, 99, 1))[:3], 3) == []


def test_recall_of_near_passages(spark):
    """Passages of 0.75 to 0.85 similarity, edited anywhere: what the rule accepts is found."""
    rng = random.Random(11)
    rows, expected = [], set()
    while len(expected) < 200:
        k = len(expected)
        words = rng.randint(50, 120)
        passage = text_of(70_000 + k, words).split()
        edited = list(passage)
        first = rng.randrange(words)
        for at in {min(words - 1, first + rng.choice([0, 1, 2])) for _ in range(max(1, words // 30))}:
            edited[at] = f"e{k}x{at}"
        same = [edited[i : i + 5] == passage[i : i + 5] for i in range(words - 4)]
        size = len(same) - same[::-1].index(True) - same.index(True) if any(same) else 0
        if size < substrings.WIDTH or 7 * sum(same) < 6 * size:
            continue
        rows += [(k, f"{text_of(k + 80_000, 40)} {' '.join(passage)}"), (1_000 + k, f"{' '.join(edited)} {text_of(k + 90_000, 30)}")]
        expected.add((1_000 + k, k))
    got = {(r.doc_id, r.first_doc_id) for r in substrings.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= expected and len(got) >= 0.98 * len(expected)


def test_mixing_without_ids_comes_near_the_targets(spark):
    """A source of rows without id, one with a null source and null texts, one without words."""
    rows = [(None, text_of(k, 50), "a", "x") for k in range(100)] + [(k, text_of(k + 200, 50), "b", "x") for k in range(100)] + [(k, text_of(k + 400, 20), None, "x") for k in range(50)]
    rows += [(k, None, "c", "x") for k in range(5)] + [(7, text_of(9, 50), "b", "x")] * 2
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, size string")).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    by_source = {}
    for r in got:
        by_source.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(taken - target) <= 100 for target, taken in by_source.values()) and by_source["c"] == [0, 0]
    assert sum(t for t, _ in by_source.values()) == pytest.approx(sum(r.size for r in got))
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_mixing_weights_come_from_every_training_text(spark):
    rows = [(k, text_of(k, 4_000)) for k in range(6)]  # over 20,000 characters each
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    coder = mixture_lm.build_coder([], len(rows), 24_000)
    mixer = mixture_lm.fit_mixer(docs, coder, mixture_lm.count_bits(docs, coder))
    assert np.abs(mixer.bytes_ - mixture_lm.even(4)).max() > 0.1
    assert min(len(t) for _, t in rows) > 20_000


def test_learner_finds_the_same_weights_in_runs():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40_000, 4)).astype(np.float32)
    gate = rng.integers(0, 3, len(x))
    y = (rng.random(len(x)) < 1 / (1 + np.exp(-(x @ [0.5, 1.0, 0.2, -0.3] * (1 + gate))))).astype(np.int8)
    whole, runs, double = (mixture_lm.Learner(4) for _ in range(3))
    whole.learn(x, gate, y)
    double.learn(x[:5_000], gate[:5_000], y[:5_000], np.full(5_000, 8))
    for first in range(0, len(x), 10_000):
        runs.learn(*(v[first : first + 10_000] for v in (x, gate, y)))
    for g in range(3):
        assert whole.w[g] == pytest.approx(np.array([0.5, 1.0, 0.2, -0.3]) * (1 + g), abs=0.15)
        assert runs.w[g] == pytest.approx(whole.w[g], abs=0.05)
        assert double.w[g] == pytest.approx(whole.w[g], abs=0.3)
    assert whole.w[3:] == pytest.approx(mixture_lm.even(4)[3:])


def test_hashing_a_large_batch_takes_bounded_memory():
    import tracemalloc

    import pandas as pd

    from quayside.llm import jaccard

    batch = pd.DataFrame({"text": [" ".join(f"w{k * 31 + i}" for i in range(2_000)) for k in range(500)]})
    tracemalloc.start()
    n = sum(len(sets) for _, sets in jaccard.each_text(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 500 and peak < 150e6


def test_known_words_are_looked_up_once(monkeypatch):
    from quayside.llm import packing

    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

        def __contains__(self, key):
            Counted.asked += 1
            return super().__contains__(key)

    texts = ["the cat sat on the mat", None, "", "Über 99% -- don't the the"]
    encoder = packing.WordEncoder(packing.default_tokenizer())
    want = [np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    encoder.words = Counted()
    assert encoder.encode(texts) == want
    Counted.asked = 0
    assert encoder.encode(texts) == want and Counted.asked == sum(len((t or "").split()) for t in texts)
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)  # tables that are emptied all the time
    assert packing.WordEncoder(packing.default_tokenizer()).encode(texts * 300) == want * 300


def test_walking_a_large_batch_takes_bounded_memory():
    import tracemalloc

    machine = toxicity.build_automaton([("kalom", False)])
    texts = ["trase kalom " * 1_000 for _ in range(300)]
    tracemalloc.start()
    n = sum(len(machine.hits(toxicity.letters_of(texts[a:b])[0])) for a, b in toxicity.in_texts(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 300_000 and peak < 30e6


def test_a_worker_keeps_no_words_of_a_task(spark):
    docs = spark.createDataFrame([(k, text_of(k, 30)) for k in range(20)], "doc_id long, text string")
    assert packing.pack_documents(docs, packing.default_tokenizer()).groupBy("doc_id").count().count() == 20

    def kept(batches):
        import gc

        import pandas as pd

        for _ in batches:
            yield pd.DataFrame({"n": [sum(type(x).__name__ == "WordEncoder" for x in gc.get_objects())]})

    assert spark.range(64).repartition(8).mapInPandas(kept, "n long").agg({"n": "max"}).head()[0] == 0


def test_stored_rows_meet_others_without_a_shuffle(spark):
    from pyspark.sql import functions as F

    from quayside.llm.common import stored_by

    rows = [(k % 50, text_of(k % 50, 5)) for k in range(200)]
    stored = stored_by(spark.createDataFrame(rows, "d long, text string").groupBy("d").agg(F.first("text").alias("text")), "d", 4)
    other = spark.range(0, 100, 2).withColumnRenamed("id", "d")
    joined = stored.join(other.hint("merge"), "d")
    assert {(r.d, r.text) for r in joined.collect()} == {(k, text_of(k, 5)) for k in range(0, 50, 2)}
    plan = joined._jdf.queryExecution().sparkPlan().toString() + joined._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") <= 2  # of the other side, in the first and the final plan


def test_text_reader_weights_move_chunk_by_chunk():
    """The vectorised scores equal a loop over every text's chunks."""
    rng = np.random.default_rng(5)
    sizes = [1, 255, 256, 257, 900, 512]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    x = mixture_lm.inputs([rng.integers(-900, 900, len(owner)).astype(np.int16) for _ in range(3)])
    y, weights = rng.integers(0, 2, len(owner)).astype(np.int8), rng.normal(0.3, 0.05, (mixture_lm.GATES, 4))
    chunks = mixture_lm.chunks_of(owner, len(sizes))
    got = mixture_lm.adaptive(x[0].T[:, chunks[0]].T, weights, x[1][chunks[0]], y[chunks[0]], chunks, len(sizes))
    for t in range(len(sizes)):
        (own,), moved, total = np.nonzero(owner == t), np.zeros(4), 0.0
        for first in range(0, len(own), mixture_lm.CHUNK):
            at = own[first : first + mixture_lm.CHUNK]
            p = 1 / (1 + np.exp(-(x[0][at] * (weights[x[1][at]] + moved)).sum(axis=1, dtype=float)))
            total += np.log(np.where(y[at] == 1, p, 1 - p)).sum()
            moved = moved + mixture_lm.RATE * ((y[at] - p) @ x[0][at])
        assert got[t] == pytest.approx(total, rel=1e-4)


def test_symbols_are_those_of_a_dictionary():
    rng = np.random.default_rng(6)
    known = np.unique(rng.integers(0, 1 << 63, 3_000)).tolist()
    known += [known[0] + k for k in range(1, 9)]
    for words in ([], known):
        coder = mixture_lm.build_coder([(h, 2) for h in words], 5, 5)
        asked = np.array(known + [h + 20 for h in known], dtype=np.int64).view(np.uint64)
        numbers = {h: k for k, h in enumerate(words, 2)}
        assert coder.symbol_of(asked).tolist() == [numbers.get(h, mixture_lm.ESCAPE) for h in asked.tolist()]


def test_top_k_sends_no_table_through_the_driver(spark, monkeypatch):
    import random

    draw = random.Random(6)
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "HELD", 500)  # several groups of queries
    values = {i: [draw.randint(-40_000, 40_000) / 1024 for _ in range(5)] if i % 4 else [1.0] * 5 for i in range(300)}
    vectors = topk.quantised(spark.createDataFrame(list(values.items()), "vec_id long, embedding array<double>").repartition(7))
    best = topk.top_k(vectors.where("vec_id % 10 = 0"), vectors, k=4)
    assert "Broadcast" not in best._jdf.queryExecution().executedPlan().toString()
    exact = {r.vec_id: list(r.v) for r in vectors.collect()}
    want = []
    for q in range(0, 300, 10):
        ranked = sorted((-sum(a * b for a, b in zip(exact[q], v)), i) for i, v in exact.items() if i != q)[:4]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(ranked, 1)]
    assert sorted(tuple(r) for r in best.collect()) == sorted(want)
