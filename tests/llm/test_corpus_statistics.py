"""Collocations, the quality discriminant and the filter audit against brute force on small, awkward tables."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarp.llm import collocations, filter_audit, quality

# Columns whose names the operators use inside are there to clash.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, n long, part string, id long, label int"


def table(spark, rows, parts=3):
    full = [(i, t, lang, "s", 1, "d", 5, "p", 7, 1) for i, t, lang in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# --- collocations


def brute_collocations(rows, least, longest, most):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", lower(text or "")):
            words = re.findall(r"[^ \t]+", piece)
            own = "und" if lang is None else lang
            n[own] += len(words)
            for k in range(1, longest + 1):
                f[own].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            inside = any(b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items())
            if not inside:
                score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrase_rows():
    r = np.random.default_rng(3)
    vocabulary = "Alpha beta GAMMA delta É é zêta x1 the of".split()
    rows = []
    for i in range(120):
        words = r.choice(vocabulary, int(r.integers(0, 40)))
        text = "".join(w + str(r.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0b", " ! "])) for w in words)
        rows.append((i, text, [None, "en", "en", "de", ""][i % 5]))
    rows += [(900, None, "en"), (901, "", None), (902, " \t .;\n", "en"), (None, "the of the of the of", "en"), (3, rows[3][1], "en"), (3, rows[3][1], "en")]
    rows += [(1000 + i, "The same piece of text again, a tail here", "en") for i in range(50)]
    return [*rows, (2000, "one two three four five six " * 3000, "fr")]


@pytest.mark.parametrize(("least", "most", "chunk", "bucket", "group"), [(3, 2000, 12 << 20, 10**6, 10**5), (5, 7, 300, 50, 3)])
def test_collocations(spark, monkeypatch, least, most, chunk, bucket, group):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "BUCKET", bucket)
    monkeypatch.setattr(collocations, "RANKED", group)
    rows = phrase_rows()
    found = collocations.collocations(table(spark, rows), least=least, most=most)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute_collocations(rows, least, 5, most)


def test_collocations_of_no_rows(spark):
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [(1, None, None), (2, "a b", "en")])).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 4 * 10**15
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", big - 1), ("en", "a b", big - 7)], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("en", 9 * 10**16)], "lang string, n long")
    assert [r["score"] for r in collocations.scored(counts, totals).collect()] == [1000 * (big - 7) * 9 * 10**16 // (big * (big - 1))]


def test_equal_cuts_go_to_the_first(spark):
    counts = spark.createDataFrame([("en", p, n) for p, n in {"a": 10, "b": 10, "c": 10, "a b": 9, "b c": 9, "a b c": 9}.items()], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("en", 100)], "lang string, n long")
    found = {r["phrase"]: (r["l"], r["r"]) for r in collocations.scored(counts, totals).collect()}
    assert found["a b c"] == (10, 9)
    assert {r["phrase"] for r in collocations.maximal(collocations.scored(counts, totals)).collect()} == {"a b c"}


def test_buckets_spill(spark, monkeypatch, tmp_path):
    """More n-grams than duckdb may hold are summed all the same."""
    import pyarrow as pa

    monkeypatch.setattr(collocations, "MEMORY", "20MB")
    step = 100_000
    tables = [pa.table({"lang": ["en"] * step, "phrase": [f"a rather long phrase with the number {j}" for j in range(i, step + i)], "n": np.ones(step, np.int64)}) for i in range(12)]
    batches = (pa.record_batch({"bucket": np.array([k]), "grams": [collocations._packed(t)]}) for k in (1, 2) for t in tables)
    found = pa.Table.from_batches(collocations._bucket(12, str(tmp_path))(batches))
    assert len(found) == 2 * (step - 11) and set(found["f"].to_pylist()) == {12}
    assert not list(tmp_path.iterdir())


# --- the filter audit


def brute_audit(rows, labels):
    def fails(i, text):
        words = re.findall(r"[^ \t-\r]+", text)
        out = set("A") if len(words) < 100 else set()
        out |= set("B") if 100 * len(set(words)) < 80 * len(words) else set()
        out |= set("C") if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        out |= set("D") if re.search(r"[#$%&*|]", text) else set()
        return out | (set("E") if any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in rows) else set())

    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    docs = defaultdict(list)
    for i, t, lang in rows:
        docs[lang or ""].append((fails(i, t or ""), i in good and i is not None, i in toxic and i is not None))
    out = []
    for part, members in docs.items():
        found = []
        for order in map("".join, itertools.permutations("ABCDE")):
            for s, x in enumerate(order):
                before = set(order[:s])
                here = [(f, g, t) for f, g, t in members if x in f and not f & before]
                kept = sum(not f & {*before, x} for f, _, _ in members)
                found.append((part, order, s + 1, kept, len(here), sum(x in f and bool(f & before) for f, _, _ in members), sum(f == {x} for f, _, _ in members), sum(g for _, g, _ in here), sum(t for _, _, t in here), x))
        total = Counter()
        for row in found:
            total[row[-1]] += row[4]
        out += [(*row[:-1], total[row[-1]]) for row in found]
    return sorted(out)


def audit_rows():
    long = " ".join(f"w{i}" for i in range(130))
    repeated = "same words again " * 60
    return [
        (1, long, "en"), (2, long, "en"), (3, long, None), (None, long, "en"), (2, long, "en"), (4, repeated, "de"), (5, long.upper(), "de"), (6, long + " a|b", "en"), (7, None, ""), (8, "", "en"),
        (9, "É" * 400, "fr"), (10, repeated.upper() + "$", "fr"), (11, repeated, "de"), (12, "\t\x0b\x0c \n", "en"), (13, "x" * 30_000 + " #", "de"), (14, " ".join(["W", "w"] * 60), "en"), (1, "another text of one", "en"),
    ]


LABELS = [(1, 1, 0), (2, 0, 1), (4, 1, 1), (4, 0, 0), (5, None, 1), (10, 1, None), (99, 1, 1), (None, 1, 1)]


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_filter_audit(spark):
    rows = audit_rows()
    found = filter_audit.audit(table(spark, rows), labelled(spark, LABELS))
    assert sorted(map(tuple, found.collect())) == brute_audit(rows, LABELS)


def test_filter_audit_with_many_copies(spark):
    rows = [(i, "copy of a text" if i % 3 else f"own text {i}", ["en", None, "de"][i % 3 - 1]) for i in range(3000)]
    found = filter_audit.audit(table(spark, rows, 7), labelled(spark, []))
    one = {(r["part"], r["filter_order"], r["step"]): r for r in found.collect()}
    assert len(one) == 3 * 600
    assert one["en", "EABCD", 1]["removed"] == 999 and one["", "EABCD", 1]["removed"] == 1000 and one["de", "EABCD", 1]["removed"] == 0
    assert filter_audit.audit(table(spark, []), labelled(spark, LABELS)).count() == 0


def test_incidence_matrices():
    m = filter_audit.incidence("ABCDE")
    assert {x.shape for x in m.values()} == {(32, 600)}
    assert (m["kept"] + m["removed"] + m["redundant"] <= 1).all() and m["unique"].sum() == 600


# --- quality


def plain_statistics(text):
    words, lines = re.findall(r"[^ \t-\r]+", text), text.split("\n")
    data = text.encode()
    counts = Counter(words)
    sets = [("A-Z"), ("a-z"), ("0-9"), (" \t-\r"), (".!?"), (",;:"), ("\"'()\\-")]
    classes = [len(re.findall(f"[{s}]", text)) for s in sets]
    symbols = sum(33 <= ord(c) < 127 for c in text) - sum(classes[:3]) - sum(classes[4:])
    controls = sum(ord(c) < 32 or ord(c) == 127 for c in text) - sum(c in "\t\n\x0b\x0c\r" for c in text)
    again = sum(a == b for a, b in itertools.pairwise(words))
    packed = min(len(data), len(zlib.compress(data, 1)))
    return [len(data), len(text), len(words), len(counts), sum(v == 1 for v in counts.values()), max(counts.values(), default=0), again, len(lines), len(set(lines)), sum(len(x.encode()) < 40 for x in lines), packed, *classes, symbols, controls]


def quality_rows():
    r = np.random.default_rng(7)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    rows, labels = [], []
    for i in range(400):
        text = " ".join(r.choice(words, int(r.integers(5, 200)))).capitalize() + "."
        bad = i % 4 == 0
        if bad:
            text = [text.upper() + "!!", text.replace(" ", " ### "), (text[:40] + "\n") * 30][i // 4 % 3]
        rows.append((i, text, "en"))
        labels.append((i, int(not bad), 0))
    return rows, labels


def brute_scores(rows, labels):
    """Gaussian log densities from whole covariance matrices, without Cholesky factors or sums."""
    lab = {}
    for i, q, _ in labels:
        if i is not None and q is not None:
            lab[i] = min(q, lab.get(i, 1))
    counts = np.array([plain_statistics(t or "") for _, t, _ in rows], float)
    train = [j for j, (i, _, _) in enumerate(rows) if i in lab and zlib.crc32(str(i).encode()) % 4 != 2]
    y = np.array([lab[rows[j][0]] for j in train])
    column = dict(zip(quality.STATISTICS, counts.T, strict=True))
    x = []
    for part, whole in quality.SHARES:
        share = min(1.0, column[part][train].sum() / max(1.0, column[whole][train].sum()))
        p = np.clip((column[part] + 20 * share) / (column[whole] + 20), 1e-6, 1 - 1e-6)
        x.append(np.log(p / (1 - p)))
    x += [np.log1p(column["words"]), np.log1p(column["lines"]), np.log1p((column["chars"] - column["blanks"]) / np.maximum(1, column["words"])), np.log1p(column["chars"] / np.maximum(1, column["lines"]))]
    x = np.stack(x, axis=1)
    spread = x[train].std(axis=0)
    x = (x - x[train].mean(axis=0)) / np.where(spread > 1e-6, spread, 1)
    d, density = x.shape[1], []
    for k in (0, 1):
        own = x[train][y == k]
        s = np.cov(own.T, bias=True)
        t2, tt = np.trace(s) ** 2, np.trace(s @ s)
        rho = min(1, max(0.02, ((1 - 2 / d) * tt + t2) / ((len(own) + 1 - 2 / d) * (tt - t2 / d))))
        s = (1 - rho) * s + rho * np.trace(s) / d * np.eye(d)
        z = x - own.mean(axis=0)
        density.append(-0.5 * np.einsum("ij,ij->i", z @ np.linalg.inv(s), z) - 0.5 * np.linalg.slogdet(s)[1])
    odds = density[1] - density[0] + np.log((sum(y == 1) + 1) / (sum(y == 0) + 1))
    return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


AWKWARD = ["", " ", "\n\n", "É é ñ", "a", "a a a\ta", "\x00\x01|", "x" * 5000, "word, word; Word. WORD!\nline\nline", "1 2 3 (4) \"5\" '6' 7-8 ~^`", "日本語 テキスト\n" * 50]


@pytest.mark.parametrize("text", AWKWARD)
def test_statistics(text):
    assert quality.statistics(text.encode()) == plain_statistics(text)


def test_quality_discriminant(spark):
    rows, labels = quality_rows()
    rows += [(1000 + i, t, None) for i, t in enumerate(AWKWARD)] + [(2000, None, "en"), (None, rows[1][1], "en"), rows[1]]
    labels += [(None, 0, 0), (1000, None, 1), (5, 1, 0), (7, 0, 0), (31337, 1, 0)]
    stats = quality.document_statistics(table(spark, rows))
    found = quality.score(stats, quality.fit(stats, labelled(spark, labels))).collect()
    want = brute_scores(rows, labels)
    key = lambda x: (str(x[0]), x[1])
    a, b = sorted(((r["id"], r["score"]) for r in found), key=key), sorted(((i, s) for (i, _, _), s in zip(rows, want, strict=True)), key=key)
    assert [x[0] for x in a] == [x[0] for x in b]
    np.testing.assert_allclose([x[1] for x in a], [x[1] for x in b], rtol=1e-6, atol=1e-9)
    held = [(s >= 0.7, i % 4 != 0) for (i, s) in a if i is not None and i < 400 and i not in (5, 7) and zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([x == y for x, y in held]) > 0.95


def test_quality_without_both_classes(spark):
    rows, labels = quality_rows()
    docs = table(spark, rows[:20])
    stats = quality.document_statistics(docs)
    for some in ([], [x for x in labels if x[1] == 1][:30]):
        model = quality.fit(stats, labelled(spark, some))
        scores = {r["score"] for r in quality.score(stats, model).collect()}
        assert model.classes is None and len(scores) == 1 and 0 < scores.pop() < 1
    none = quality.document_statistics(table(spark, []))
    assert quality.score(none, quality.fit(none, labelled(spark, labels))).count() == 0


def test_constant_statistics_are_no_trouble(spark):
    stats = quality.document_statistics(table(spark, [(i, "same text", "en") for i in range(60)]))
    found = quality.score(stats, quality.fit(stats, labelled(spark, [(i, i % 2, 0) for i in range(60)]))).select(F.round("score", 6)).distinct().collect()
    assert len(found) == 1 and 0 < found[0][0] < 1


# --- the registered queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_collocations", "op13_filter_audit"])
def test_query_against_sql(spark, name):
    import os

    import duckdb
    from tidewarp.llm import registry

    if not os.path.isdir(SF):
        pytest.skip("needs the provided tables")
    con = duckdb.connect()
    for view in ("documents", "labels"):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{SF}/{view}.parquet'")
    found = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.ORACLES[name]).df()
    assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(map(tuple, want.itertuples(index=False)))


def test_quality_query(spark):
    import os

    import duckdb
    from tidewarp.llm import registry

    if not os.path.isdir(SF):
        pytest.skip("needs the provided tables")
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()
    labels = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SF}/labels.parquet'").fetchall()
    found = {r["doc_id"]: r for r in registry.QUERIES["op12_quality_discriminant"](spark, SF).collect()}
    want = brute_scores(rows, labels)
    assert len(found) == len(rows)
    for (i, _, _), s in zip(rows, want, strict=True):
        assert abs(found[i]["score"] - s) < 1e-6 and found[i]["predicted"] == int(found[i]["score"] >= 0.7) and found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
