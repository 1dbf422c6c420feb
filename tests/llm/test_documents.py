"""Operators on documents: packing, leakage, text quality."""

import random

import numpy as np
import pytest

from codestrata.llm import leakage, packing, quality, queries
from tests.conftest import rows


def test_pack_respects_all_limits():
    rng = np.random.default_rng(1)
    sizes = np.stack([rng.integers(1, 2048, 3000), np.ones(3000, dtype=int), rng.integers(0, 900, 3000)], axis=1)
    limits = np.array([2048, 6, 2048])
    number = packing.pack(sizes, limits)
    sums = np.zeros((number.max() + 1, 3), dtype=int)
    np.add.at(sums, number, sizes)
    assert (sums <= limits).all()
    assert sums[:, 0].sum() / (2048 * len(sums)) > 0.97


def test_packing_is_a_round_trip(spark, make):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "符号"]) for _ in range(rng.choice([1, 20, 300, 5000]))) for _ in range(120)] + ["", None, "same text", "same text"]
    docs = make("documents", [{"doc_id": i, "text": t} for i, t in enumerate(texts)])
    items = packing.pieces(docs).cache()
    packed = packing.pack_documents(items, per_group=40)
    encoder = packing._encoder(packing.tokenizer_path())
    spans = {}
    for r in packed.collect():
        spans.setdefault(r.doc_id, []).append((r.piece, r.token_start, r.tokens))
    for i, t in enumerate(texts):
        total = len(encoder.encode_ordinary(t)) if t else 0
        found = sorted(spans.get(i, []))
        assert sum(n for _, _, n in found) == total and [s for _, s, _ in found] == list(range(0, total, packing.CAPACITY))
    fill = packing.container_fill(packed)
    assert fill.where("tokens > 2048 or segments > 512 or loss_tokens > 2048 or unused < 0").count() == 0


def test_prompt_tokens_bear_no_loss(spark):
    docs = spark.createDataFrame([(1, "ask this now answer that", "ask this now")], "doc_id long, text string, ask string")
    r = packing.pieces(docs, prompt="ask").first()
    assert 0 < r.loss_tokens < r.tokens


def test_first_paragraph_bears_no_loss(spark):
    texts = ["ask this\n \nanswer that and more", "one paragraph\nof two lines", "ends in nothing\n\n  \n", "\n\nask\n\nsay", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.tokens, r.loss_tokens) for r in packing.pieces(docs).collect()}
    assert 0 < got[0][1] < got[0][0] and got[1][0] == got[1][1] and got[2][0] == got[2][1] and 0 < got[3][1] < got[3][0] and 4 not in got


@pytest.mark.parametrize("limits", [(2048, 1, 1000), (100, 3, 40), (50, 64, 7)])
def test_every_limit_binds_and_every_token_is_packed(spark, limits):
    capacity, segments, loss = limits
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join("word" for _ in range(rng.choice([2, 9, 60, 1900]))) + ("\n\n" + "say " * rng.randrange(1, 90)) * (i % 2)) for i in range(60)], "doc_id long, text string")
    items = packing.pieces(docs, capacity, loss_tokens=loss).cache()
    packed = packing.pack_documents(items, capacity, segments, loss, per_group=30)
    fill = packing.container_fill(packed, capacity)
    top = fill.selectExpr("max(tokens) t", "max(segments) s", "max(loss_tokens) l", "sum(tokens) n").first()
    assert top.t <= capacity and top.s <= segments and top.l == loss and (segments > 3 or top.s == segments)
    assert top.n == items.selectExpr("sum(tokens)").first()[0]
    whole = items.selectExpr("doc_id", "tokens", "loss_tokens", "token_start", "piece").orderBy("doc_id", "piece").collect()
    for a, b in zip(whole, whole[1:]):
        assert (b.token_start == a.token_start + a.tokens and max(a.tokens / capacity, a.loss_tokens / loss) == 1) if a.doc_id == b.doc_id else b.token_start == 0


def test_pieces_beyond_a_limit_are_an_error(spark):
    items = spark.createDataFrame([(1, 0, 0, 1500, 1500)], "doc_id long, piece int, token_start long, tokens int, loss_tokens int")
    with pytest.raises(ValueError):
        packing.pack_documents(items, loss_tokens=1000)
    with pytest.raises(ValueError):
        packing.pack(np.array([[1500, 1, 1500]]), np.array([2048, 512, 1000]))


def brute_leaks(docs, items):
    return sorted((d, i) for d, t in docs for i, p in items if t and p and leakage.shares_run(t, p))


def test_leaks_against_brute_force(spark, make):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(6)] + ["".join(chr(0x4E00 + rng.randrange(300)) for _ in range(80)), None, "too short"]
    passages[3] = passages[2][: len(passages[2]) // 2] + passages[3]
    docs = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(10, 200))]
        p = rng.choice(passages[:6]).split()
        at, n = rng.randrange(40), rng.choice([13, 14, 15, 16, 25])
        piece = [w.upper() if rng.random() < 0.3 else w for w in p[at:at + n]]
        k = rng.randrange(len(words))
        docs.append((i, rng.choice([" ", ", ", "-\n"]).join(words[:k] + (piece if i % 3 else []) + words[k:])))
    docs += [(100, "x " + ", ".join(passages[6][10:40])), (101, " ".join(passages[6][10:39])), (102, None), (103, "")]
    got = leakage.leaked_items(make("documents", [{"doc_id": i, "text": t} for i, t in docs]), make("eval_items", [{"item_id": i, "passage": p} for i, p in enumerate(passages)]))
    want = brute_leaks(docs, list(enumerate(passages)))
    assert rows(got, "doc_id", "item_id") == sorted(want, key=repr) and len(want) > 15 and (100, 6) in want and (101, 6) not in want


@pytest.mark.parametrize("broadcast", [True, False])
def test_short_pieces_in_long_documents_by_both_ways(spark, make, broadcast):
    """Pieces of the least length of passages of every size class, in documents of up to 4,000 words; recall is 1 but for a chance of MISS."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh0") for _ in range(rng.randrange(2, 7)))
    passages = [[word() for _ in range(n)] for n in (14, 15, 16, 20, 31, 40, 64, 90, 150, 260, 500)]
    docs = []
    for i in range(120):
        p = passages[i % len(passages)]
        at = rng.randrange(max(1, len(p) - 14))
        text = [word() for _ in range(rng.choice([20, 300, 4000]))]
        k = rng.randrange(len(text))
        docs.append((i, "é ".join(text[:k] + p[at:at + 15] + text[k:])))
    zh = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400))
    docs += [(200, "x" + zh[50:80] + "y"), (201, zh[50:79]), (202, " 、".join(zh[100:131])), (203, None), (204, ""), (205, "a" * 500_000)]
    items = [(i, " ".join(p)) for i, p in enumerate(passages)] + [(50, zh), (51, None), (52, "")]
    got = leakage.leaked_items(make("documents", [{"doc_id": i, "text": t} for i, t in docs]), make("eval_items", [{"item_id": i, "passage": p} for i, p in items]), broadcast)
    want = {(d, i) for d, t in docs for i, p in items if t and p and leakage.shares_run(t, p)}
    assert rows(got, "doc_id", "item_id") == sorted(want, key=repr) and {(200, 50), (202, 50)} <= want and len(want) > 100


def test_shingle_hashes_equal_for_equal_words_only():
    texts = ["One two, three-four five six", "one TWO three four five", "x" * 5000 + " two three four five", "", "12 two three four five", "\u4e00" * 12, "ü one two three four five\n"]
    h, owner = leakage.shingles(texts)
    by = {i: set(h[owner == i].tolist()) for i in range(len(texts))}
    assert len(by[0]) == 2 and len(by[1]) == 1 and by[1] < by[0] and by[1] == by[6] and len(by[2]) == 1 and not by[2] & by[1] and not by[3] and not by[4] & by[1] and len(by[5]) == 1
    many = [" ".join(f"w{i * k}" for i in range(60_000)) for k in (1, 2)]
    h, owner = leakage.shingles(many)
    assert (np.bincount(owner) == 59_996).all() and len(np.unique(h)) == len(h)


def test_size_classes_and_their_bands():
    assert [leakage.size_class(n) for n in (1, 11, 16, 17, 64)] == [1, 16, 16, 32, 64]
    for upper in (16, 32, 64, 512):
        assert (1 - 11 / upper) ** leakage.bands(upper, 11) <= leakage.MISS
    assert leakage.bands(8, 11) == 1


def test_learned_rules_hold_out():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    truth = np.where(x[:, 0] > 0.6, "prose", np.where(x[:, 1] > 0.7, "table", np.where(x[:, 2] > 0.5, "list", "junk"))).astype(object)
    noisy = truth.copy()
    flip = rng.random(2000) < 0.1
    noisy[flip] = rng.choice(["prose", "table", "list", "junk"], flip.sum())
    rules = quality.learn_rules(x[:1400], noisy[:1400])
    got = np.full(600, "junk", dtype=object)
    done = np.zeros(600, dtype=bool)
    for kind, rule in rules:
        hit = quality._matches(rule, x[1400:]) & ~done
        got[hit], done = kind, done | hit
    assert (got == truth[1400:]).mean() > 0.93


PROSE = "The loader keeps the list of files in the order of their lines. It drops what is not used after a change."
TEXTS = {
    "prose": PROSE, "zh": "符号表会收集所有未解析的调用直到队列为空为止。解析器会丢弃重复的代码行。", "list": "\n".join(f"- add walk item{i}" for i in range(12)),
    "table": "\n".join(f"| a{i} | {i} | b{i} |" for i in range(12)), "junk": "zxq\u00d0\u00a1\u00d0\u00b1 ]}{;:<>/ " * 12, "empty": "", "null": None, "spaces": "  \n ", "long": "x" * 200_000,
}


def test_statistics(spark, make):
    docs = make("documents", [{"doc_id": i, "text": t} for i, t in enumerate(TEXTS.values())])
    got = {name: r for name, r in zip(TEXTS, quality.text_statistics(docs).orderBy("doc_id").collect())}
    assert got["prose"].sentence_share == 1.0 and got["zh"].sentence_share == 1.0
    assert got["list"].bullet_line_share == 1.0 and got["list"].sentence_share == 0.0
    assert got["table"].cell_line_share == 1.0
    assert got["prose"].words == 22 and got["prose"].closed_line_share == 1.0 and abs(got["prose"].mean_word_length - sum(len(w.strip(".")) for w in PROSE.split()) / 22) < 1e-9
    for name in ("empty", "null", "spaces"):
        assert got[name].words == 0 and got[name].sentence_share == 0.0
    assert got["long"].longest_word == 200_000


def test_p10_over_tables(spark, folder):
    docs, labels = [], []
    kinds = ["prose", "list", "table", "junk"]
    for i in range(160):
        kind = kinds[i % 4]
        docs.append({"doc_id": i, "text": TEXTS[kind] + ("\n" + TEXTS[kind]) * (i % 3)})
        if i < 120:
            labels.append({"doc_id": i, "label": kind, "annotator": "a"})
    labels += [{"doc_id": 0, "label": None, "annotator": "b"}, {"doc_id": 4, "label": "junk", "annotator": "b"}, {"doc_id": 999, "label": "list", "annotator": "b"}]
    docs.append({"doc_id": 500, "text": None})
    d = folder(documents=docs, doc_labels=labels)
    got = dict(rows(queries.p10_found(spark, d), "doc_id", "text_kind"))
    assert got.pop(500) == "junk"
    assert got == {i: kinds[i % 4] for i in range(160) if i % 4}


def test_agreed_labels(spark, make):
    votes = [(1, "list", "a"), (1, "list", "b"), (1, "junk", "c"), (2, "list", "a"), (2, "junk", "b"), (3, None, "a"), (4, "table", "a"), (4, "table", "a")]
    df = make("doc_labels", [{"doc_id": i, "label": l, "annotator": a} for i, l, a in votes])
    assert rows(quality.agreed_labels(df), "doc_id", "label") == [(1, "list"), (4, "table")]


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, empty_folder, name):
    assert queries.queries()[name](spark, empty_folder).count() == 0
