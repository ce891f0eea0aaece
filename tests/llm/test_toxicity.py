from flowglass.llm import toxicity as T


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    train = labels.filter("doc_id % 5 <> 0")
    chain = T.fit(docs, T.weak_labels(docs, train), [*T.CATEGORIES, "toxic"])
    rows = T.score(docs, chain).collect()
    assert len(rows) == docs.count()
    flagged = {r.doc_id for r in rows if r.flagged}
    test = {r.doc_id: r.toxic for r in labels.filter("doc_id % 5 = 0").collect()}
    bad, clean = ({i for i, y in test.items() if y == k} for k in (1, 0))
    assert len(bad & flagged) >= 0.93 * len(bad)
    assert len(clean & flagged) <= 0.005 * len(clean)
    assert all(0 <= r[f"p_{c}"] <= 1 for r in rows for c in [*T.CATEGORIES, "toxic"])


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "", 2), (None, "idiot", 3), (3, "x " * 50_000, 4)], "doc_id long, text string, flagged int")
    labels = spark.createDataFrame([(1, None, 1), (2, 0, 0), (2, 0, 0), (None, 1, 1), (3, 0, 0)], "doc_id long, toxic int, quality int")
    for have in (labels, labels.filter("doc_id > 99")):
        rows = T.score(docs, T.fit(docs, T.weak_labels(docs, have), [*T.CATEGORIES, "toxic"])).collect()
        assert len(rows) == 5 and not any(r.flagged for r in rows)
        assert len({tuple(round(float(x), 9) for x in tuple(r)[1:]) for r in rows}) == 1
    assert T.score(docs.filter("doc_id > 99"), T.fit(docs, T.weak_labels(docs, labels), [*T.CATEGORIES, "toxic"])).count() == 0


def test_word_hash_is_the_listed_one(spark):
    row = T._words(spark.createDataFrame([("Idiot idiot X", 1)], "text string, doc_id long"), ["doc_id"]).first()
    assert set(row.words) == set(T.word_hashes(["idiot", "x"]).view("int64").tolist())


def test_chain_recomputed_plainly(spark):
    import re
    import zlib

    import numpy as np

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    chain = T.fit_weak(docs, labels)
    known, texts = {}, {r.doc_id: r.text or "" for r in docs.collect()}
    for r in labels.collect():
        known[r.doc_id] = max(known.get(r.doc_id, 0), r.toxic)

    def words(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return {x.encode() for x in w}

    def present(t):
        w = words(t)
        h = set(T.word_hashes([x.decode() for x in sorted(w)]).tolist()) if w else set()
        # stems: the first bytes of longer words
        stems = {bytes(x[: T.STEM]) for x in w if len(x) > T.STEM}
        return h, stems

    # presence by the operator's own word table, everything after it by plain arithmetic
    seen = {r.doc_id: set(r.words) for r in T._words(docs.select("text", "doc_id"), ["doc_id"]).collect()}
    some = sorted(texts)[:25]
    for d in some:
        assert present(texts[d])[0] <= {x & (1 << 64) - 1 for x in seen[d]}
    kin = {}
    for r in T._words(docs.select("text", "doc_id"), ["doc_id"]).collect():
        if r.doc_id in known:
            kin[r.kin] = min(kin.get(r.kin, r.doc_id), r.doc_id)
    train = sorted(kin.values())
    terms = chain.terms.view(np.int64).tolist()
    x = np.array([[1.0, *(t in seen[d] for t in terms)] for d in train], float)
    ys = [[known[d] and any(int(h) in seen[d] for h in T.word_hashes(v).view(np.int64)) for d in train] for v in T.CATEGORIES.values()] + [[known[d] for d in train]]
    fold = np.array([zlib.crc32(str(d).encode()) % T.FOLDS for d in train])
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def newton(a, b):
        w = np.zeros(a.shape[1])
        for _ in range(12):
            p = sigmoid(a @ w)
            pen = np.full(len(w), T.RIDGE)
            pen[0] = 1e-6
            move = np.linalg.solve(a.T @ np.diag(p * (1 - p)) @ a + np.diag(pen), a.T @ (p - b) + pen * w)
            new = w - move * min(1.0, 8.0 / max(1e-12, np.abs(move).max()))
            done, w = np.abs(new - w).max() < 1e-6, new
            if done:
                break
        return w

    assert len(terms) > 0 and len(chain.weights) == len(ys)
    for y, mine in zip(ys, chain.weights):
        y = np.array(y, float)
        assert np.abs(newton(x, y) - mine).max() < 1e-6
        apart = np.zeros(len(y))
        for f in range(T.FOLDS):
            apart[fold == f] = sigmoid(x[fold == f] @ newton(x[fold != f], y[fold != f]))
        x = np.concatenate([x, apart[:, None]], axis=1)
    scored = {r.doc_id: r for r in T.score(docs, chain).collect()}
    for d in sorted(texts)[::7]:
        row = np.array([1.0, *(t in seen[d] for t in terms)])
        for name, w in zip(chain.names, chain.weights):
            p = float(sigmoid(row @ w))
            assert abs(p - scored[d][f"p_{name}"]) < 1e-9
            row = np.append(row, p)
