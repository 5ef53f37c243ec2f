import random

from loomline.llm.leaks import Index, find_leaks, passages, tile, tokens

RND = random.Random(6)
VOCABULARY = [a + b + c for a in ("ka", "lo", "mi", "su") for b in ("ran", "tel", "vor", "dix") for c in ("us", "ia", "en", "o")]


def passage(n, rnd=RND):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def brute_tiles(doc, item, n):
    d, p, total = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and d[i + k] and p[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < n:
            return total
        d[i : i + k] = [False] * k
        p[j : j + k] = [False] * k
        total += k


def test_tiling_against_brute_force():
    rnd = random.Random(1)
    for _ in range(60):
        doc, item = ([rnd.choice("abcdef") for _ in range(rnd.randrange(5, 60))] for _ in range(2))
        tiles = tile(doc, item, 3)
        assert all(doc[i : i + k] == item[j : j + k] and k >= 3 for i, j, k in tiles)
        used = [x for _, j, k in tiles for x in range(j, j + k)]
        assert len(used) == len(set(used))
        assert len(used) >= 0.8 * brute_tiles(doc, item, 3)  # the order of equally long tiles is free


def test_tokens_ignore_looks():
    assert tokens("[00:00:12] Speaker 2: Ünder, um the ﬁsh­—TWO") == ["under", "the", "fish", "two"]


def test_hostile_texts_end():
    index = Index({1: passage(30).split(), 2: ["same"] * 30})
    for text in ("1" * 200_000, "same " * 20_000, "[" * 100_000, "**a" * 40_000, ">> " * 60_000):
        assert set(index.find(tokens(text))) <= {2}


def leaks(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, size int")
    i = spark.createDataFrame(items, "item_id bigint, text string, tiled string")
    return {(r.doc_id, r.item_id) for r in find_leaks(d, i).collect()}


def test_whole_partial_and_reordered(spark):
    items = {k: passage(60) for k in range(6)}
    w = {k: v.split() for k, v in items.items()}
    noise = lambda: " ".join(f"noise{RND.randrange(9999)}" for _ in range(60))
    changed = " ".join(x if n % 7 else "other" for n, x in enumerate(w[3]))
    docs = [
        (1, f"{noise()} {items[0]} {noise()}", 0),
        (2, f"{noise()} {' '.join(w[1][:25]).upper()}. {noise()}", 0),
        (3, " ".join(w[2][40:60]) + noise() + " " + " ".join(w[2][:20]), 0),
        (4, changed, 0),
        (5, f"{noise()} {' '.join(w[4][:12])} {noise()}", 0),
        (6, None, 0), (7, "", 0), (8, noise(), 0), (9, f"{noise()} {items[0]}", 0),
    ]
    assert leaks(spark, docs, [(k, v, "") for k, v in items.items()]) == {(1, 0), (2, 1), (3, 2), (4, 3), (9, 0)}
    assert leaks(spark, docs[:0], [(1, "x y z", "")]) == leaks(spark, docs, []) == set()


def test_shared_instructions_are_no_passage(spark):
    head = "Read the passage below and answer the question in one sentence. "
    items = [(k, head + passage(12) + ".", "") for k in range(5)]
    assert leaks(spark, [(1, head * 3, 0)], items) == set()
    assert all(len(p) == 12 for p in passages([(k, t) for k, t, _ in items]).values())


def test_questions_on_one_passage_keep_it(spark):
    head, shared = "Read this and answer. ", passage(60) + "."
    questions = [f"{shared} {passage(9)}?" for _ in range(3)]
    items = [(k, q, "") for k, q in enumerate(questions)] + [(k + 3, head + q, "") for k, q in enumerate(questions)] + [(6 + k, head + passage(50), "") for k in range(3)]
    assert leaks(spark, [(1, f"{passage(30)} {shared} {passage(30)}", 0), (2, head, 0)], items) == {(1, k) for k in range(6)}
    found = passages([(k, t) for k, t, _ in items] + [(99, questions[0])] * 4)
    assert [len(found[k]) for k in range(9)] == [69] * 6 + [50] * 3


def test_what_tells_a_passage_does_not_depend_on_the_size_of_the_set():
    rnd = random.Random(5)
    texts = {k: passage(50, rnd).split() for k in range(40)}
    more = texts | {k: [w + "x" for w in passage(50, rnd).split()] for k in range(40, 4000)}
    doc = passage(20, rnd).split() + texts[7][10:30] + passage(20, rnd).split()
    assert set(Index(texts).find(doc)) == set(Index(more).find(doc)) == {7}


def test_similar_sentences_are_no_leak():
    frame = "in spring the {} fair brings {} painted carts to the {} near {} and its rival {} until {}"
    rnd = random.Random(3)
    fill = lambda: frame.format(*(rnd.choice(VOCABULARY) + rnd.choice(VOCABULARY) for _ in range(6)))
    items = {k: tokens(fill() + " " + fill()) for k in range(30)}
    index = Index(items)
    assert index.find(tokens(fill() + " " + fill())) == {} and index.find(items[4]) == {4: (len(items[4]), len(items[4]))}


def test_blocks_find_the_same(spark, monkeypatch):
    import loomline.llm.leaks as m

    items = [(k, passage(40), "") for k in range(8)]
    docs = [(k, items[k][1], 0) for k in range(8)]
    monkeypatch.setattr(m, "BLOCK_TOKENS", 90)
    assert leaks(spark, docs, items) == {(k, k) for k in range(8)}
