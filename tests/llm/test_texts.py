"""Rules, licenses, classifiers and mixing: counts against brute force, held-out accuracy, and the defined cases."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from outcomelake.llm import labelled, license_templates, mixing, rule_trees, subword, weak_supervision

DIR = "/root/testdata/sf0.01"
CASES = [(1, ""), (2, None), (None, "some words here"), (4, "same row"), (4, "same row"), (5, "é" * 10 + " \U0001f600 " + "x " * 60_000), (6, "\n\n \t")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet").cache(), spark.read.parquet(f"{DIR}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame([(i, t, "en", -1.0, "x") for i, t in CASES], "doc_id long, text string, lang string, score double, kept string")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def accuracy(scored, labels, column):
    both = scored.join(labels.select("doc_id", F.col(column).alias("label")), "doc_id").where("held_out and label is not null")
    return both.agg(F.avg((F.col("predicted") == F.col("label")).cast("double"))).first()[0], both.count()


def brute_counts(text):
    text = text or ""
    words, lines, dup = re.findall(r"[^\x20\x09-\x0D]+", text), set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_rules_count_right_and_follow_labels(spark, tables):
    docs, labels = tables
    got = rule_trees.quality_rules(docs, labels).toPandas().set_index("doc_id")
    texts = docs.toPandas().set_index("doc_id").text
    want = [brute_counts(t) for t in texts]
    own = got.loc[texts.index, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]
    assert [tuple(map(int, r)) for r in own.to_numpy()] == want
    failed = (got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words)
    assert (got.base_failed == failed).all() and (got.kept == (~failed & (got.score >= 0.5))).all()
    both = got.join(labels.toPandas().set_index("doc_id").quality, how="inner")
    both = both[~both.base_failed]
    assert (both.kept == (both.quality == 1)).mean() > 0.98


def test_trees_are_monotonic():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(600, 2))
    y = ((x[:, 0] + 0.3 * rng.normal(size=600) < 0.6) & (x[:, 1] > 0.2)).astype(float)
    trees = rule_trees.boost(x, y, (-1, 0))
    assert ((trees.probabilities(x) >= 0.5) == y).mean() > 0.85
    for b in rng.uniform(size=20):
        scores = trees.margins(np.stack([np.linspace(-1, 2, 200), np.full(200, b)], axis=1))
        assert (np.diff(scores) <= 1e-9).all()


def test_flat_trees_equal_a_walk_from_the_root():
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(300, 4))
    trees = rule_trees.boost(x, ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float), (0, 0, 1, -1), rounds=12)

    def walked(row, node):
        if trees.left[node] == node:
            return trees.value[node]
        return walked(row, trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node])

    probes = np.vstack([x[:50], rng.uniform(-1, 2, size=(50, 4))])
    want = [trees.base + sum(walked(row, root) for root in trees.roots) for row in probes]
    assert np.allclose(trees.margins(probes), want) and len({round(w, 9) for w in want}) > 5


def test_rule_cases(odd):
    docs, labels = odd
    got = {}
    for r in rule_trees.quality_rules(docs, labels).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.word_chars, r.n_repeat_words, r.base_failed, r.kept))
    empty = [(0, 0, 0, True, False)]
    assert got == {1: empty, 2: empty, 6: empty, None: [(3, 13, 0, True, False)], 4: [(2, 7, 0, True, False)] * 2, 5: [(60_002, 60_011, 60_000, True, False)]}
    assert rule_trees.quality_rules(docs.limit(0), labels.limit(0)).count() == 0


def test_quality_held_out(tables):
    docs, labels = tables
    scored = subword.quality_scores(docs, labels)
    share, n = accuracy(scored, labels, "quality")
    assert n > 80 and share > 0.97
    assert scored.count() == docs.count() and scored.where("score between 0 and 1").count() == docs.count()
    assert scored.where(F.col("held_out") != (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1)).count() == 0


def test_toxicity_held_out(tables):
    docs, labels = tables
    share, n = accuracy(weak_supervision.toxicity_scores(docs, labels), labels, "toxic")
    assert n > 50 and share > 0.95


@pytest.mark.parametrize(("share", "copies"), [(0.02, False), (0.3, False), (0.6, False), (0.9, False), (0.35, True), (0.6, True)])
def test_toxicity_at_every_share(spark, share, copies):
    """Distinct toxic documents, or a third of all rows as copies of one toxic text beside distinct ones."""
    rng, n = np.random.default_rng(7), 3000
    plain, bad = [f"{a}{b}" for a in "bcdfghjk" for b in ("alo", "emi", "iru", "opa", "usa", "ane", "ilo")], ["vilescum", "grubbertwit", "snorkhead", "moldwretch"]
    copied = " ".join([*rng.choice(plain, 30), *bad[:2]])
    rows = []
    for i in range(n):
        toxic = i < share * n
        words = [*rng.choice(plain, 30), *(rng.choice(bad, 2) if toxic else ())]
        rng.shuffle(words)
        rows.append((i, copied if copies and i < n // 3 else " ".join(words), int(toxic)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    wrong = weak_supervision.toxicity_scores(docs, labels).join(labels, "doc_id").where("predicted <> toxic").groupBy("toxic").count().collect()
    assert sum(r["count"] for r in wrong) <= 0.01 * n, wrong
    left = {r.doc_id for r in weak_supervision.without_toxic(docs, labels).collect()}
    assert len(left ^ {i for i, _, t in rows if not t}) <= 0.01 * n


@pytest.mark.parametrize("score", [subword.quality_scores, weak_supervision.toxicity_scores])
def test_score_cases(odd, score):
    docs, labels = odd
    got = score(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(CASES)
    assert got.where("score between 0 and 1 and (predicted = 1) = (score >= 0.5)").count() == len(CASES)
    assert got.where("doc_id is null and not held_out").count() == 1
    assert score(docs.limit(0), labels.limit(0)).count() == 0


def test_score_cases_with_a_fitted_model(spark, odd, tables):
    docs, labels = tables
    both = docs.select("doc_id", "text").unionByName(odd[0].selectExpr("-10 - coalesce(doc_id, 0) as doc_id", "text"))
    for score in (subword.quality_scores, weak_supervision.toxicity_scores):
        assert score(both, labels).where("doc_id < 0 and score between 0 and 1").count() == len(CASES)


def test_stages_keep_columns(odd):
    docs, labels = odd
    for keep in (subword.without_low_quality, weak_supervision.without_toxic):
        assert keep(docs, labels).columns == docs.columns
    assert weak_supervision.without_toxic(docs, labels).count() == len(CASES)


@pytest.mark.parametrize("flips", [0.0, 0.03, 0.1])
@pytest.mark.parametrize("seed", range(10))
def test_label_model_finds_accuracies_and_doubles(seed, flips):
    rng = np.random.default_rng(seed)
    truth = rng.uniform(size=4000) < 0.3
    right = [0.95, 0.85, 0.75, 0.6]
    votes = np.stack([np.where(rng.uniform(size=4000) < p, truth, ~truth) for p in right], axis=1).astype(int)
    alone = weak_supervision.fit_label_model(votes, 0.3).posterior(votes)
    votes = np.column_stack((votes, np.where(rng.uniform(size=4000) < flips, 1 - votes[:, 2], votes[:, 2])))  # one voter repeats another
    model = weak_supervision.fit_label_model(votes, 0.3)  # without any label
    assert np.abs(model.accuracies[:4] - right).max() < 0.06
    assert model.parents[4] == 2 or model.parents[2] == 4
    posterior = model.posterior(votes)
    assert ((posterior >= 0.5) == truth).mean() > 0.94
    assert np.abs(posterior - alone).mean() < 0.02  # the double adds next to nothing


def test_label_model_with_abstaining_voters():
    """Voters that vote for one class or not at all, two of them in the same rows."""
    rng = np.random.default_rng(3)
    truth = rng.uniform(size=6000) < 0.25
    rates = [(0.5, 0.02), (0.4, 0.05), (0.3, 0.01), (0.6, 0.2)]  # of a vote in toxic and in clean rows
    votes = np.stack([np.where(rng.uniform(size=6000) < np.where(truth, a, b), 1, 2) for a, b in rates], axis=1)
    clean = np.where(rng.uniform(size=6000) < np.where(truth, 0.1, 0.7), 0, 2)
    votes = np.column_stack((votes, votes[:, 0], clean))
    model = weak_supervision.fit_label_model(votes, 0.25)
    want = [0.25 * a / (0.25 * a + 0.75 * b) for a, b in rates]
    assert np.abs(model.accuracies[:4] - want).max() < 0.08 and model.parents[4] == 0
    assert ((model.posterior(votes) >= 0.5) == truth).mean() > 0.88


def test_one_voter_or_none_that_agree():
    for votes in (np.array([[1], [0], [2], [1]]), np.full((5, 3), 2), np.array([[1, 2], [2, 1], [1, 2], [2, 2]])):
        q = weak_supervision.fit_label_model(votes, 0.3).posterior(votes)
        assert np.isfinite(q).all() and ((q >= 0) & (q <= 1)).all()


def test_a_repeated_id_is_one_row_of_the_sample(spark):
    """One id in 50,000 rows, with texts and labels that differ, gives one row; texts are bounded by bytes, too."""
    docs = spark.range(50_000).selectExpr("7L as doc_id", "concat('w', id % 3) as text").union(spark.range(20).selectExpr("100 + id as doc_id", "repeat('x', 1000) as text"))
    labels = spark.createDataFrame([(7, 1), (7, 0), (7, 1), *((100 + i, i % 2) for i in range(20))], "doc_id long, quality int")
    take = lambda **more: labelled.labelled_sample(docs, labels, label_col="quality", rows=30, **more).toPandas()
    found = take()
    assert sorted(found.id) == [7, *range(100, 120)] and found.set_index("id").label[7] == 1
    assert (found.set_index("id").text[7], found.text.map(len).sum()) == (take().set_index("id").text[7], 20_002)
    few = take(most_bytes=5500)
    assert len(few) in (5, 6) and set(few.id) < set(found.id) and len(take(most_bytes=10)) == 1
    by_class = take(by_class=True, most_bytes=8000).label.value_counts()
    assert by_class[0] == 4 and by_class[1] in (4, 5)


@pytest.mark.parametrize("score", [subword.quality_scores, weak_supervision.toxicity_scores, rule_trees.quality_rules])
def test_repeated_ids_with_other_texts_and_labels(spark, tables, score):
    """An id in many rows, with texts and labels that differ, fits a model that does not vary between runs."""
    docs, labels = (t.limit(300) for t in tables)
    docs = docs.select("doc_id", "text").union(spark.range(3000).selectExpr("5L as doc_id", "concat('word ', id % 7, ' again') as text"))
    labels = labels.union(spark.createDataFrame([(5, 0, 1), (5, 1, 0), (5, 0, 1)], labels.schema))
    column = "score"
    once, again = (sorted((str(r.doc_id), r[column]) for r in score(d, labels).select("doc_id", column).collect()) for d in (docs, docs.repartition(5)))
    assert [i for i, _ in once] == [i for i, _ in again] and len(once) == docs.count()
    assert np.allclose([x for _, x in once], [x for _, x in again], rtol=0, atol=1e-9)  # sums of floats come in another order


def test_sample_is_bounded_and_leaves_the_fold_out(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "concat('t', id) as text")
    labels = spark.range(300).selectExpr("id as doc_id", "cast(id % 2 as int) as quality").union(spark.createDataFrame([(5, 0)], "doc_id long, quality int"))
    kept = labelled.labelled_sample(docs, labels, label_col="quality", rows=40, keep=labelled.fold(F.col("id"), 3) != 1, by_class=True).toPandas()
    assert len(kept) == 80 and kept.label.value_counts().to_dict() == {0: 40, 1: 40} and kept.id.is_unique


def brute_licenses(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words, places, labels = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low), [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(spark, tables):
    docs = tables[0].select("doc_id", "text")
    odd = ["MIT\n\nLicense mit license", "apache-license, the MIT", "gnu GENERAL public license, as published by version 3", "General Public", "é mit license é", "mit  licenses", "X" * 100_000 + " mit license", None, ""]
    rows = docs.unionByName(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = license_templates.license_scan(rows).toPandas().set_index("doc_id")
    for doc_id, text in rows.toPandas().itertuples(index=False):
        r = got.loc[doc_id]
        mine = (r.n_words, r.n_base, *(None if x != x or x is None else int(x) for x in (r.first_word, r.last_word)), r.base_labels)
        assert mine == brute_licenses(text), doc_id
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert (got[got.labels == ""].score == 0).all() and (got.labels != "").sum() > 30


@pytest.mark.parametrize(
    ("template", "text", "taken"),
    [
        ("a <<beginOptional>>b c<<endOptional>> d", "a d", 2), ("a <<beginOptional>>b c<<endOptional>> d", "a b c d x", 4), ("a <<beginOptional>>b c<<endOptional>> d", "a b d", 0),
        ("a <<var;name=x;words=1-2>> d", "a q d", 3), ("a <<var;name=x;words=1-2>> d", "a q q d", 4), ("a <<var;name=x;words=1-2>> d", "a d", 0), ("a <<var;name=x;words=1-2>> d", "a q q q d", 0),
        ("a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d", "a b d", 3),
    ],
)
def test_template_markup(template, text, taken):
    assert license_templates.compiled("x", template).longest(text.split(), 0) == taken


def naive_labels(text, notices):
    """Labels by a regular expression for each template, tried at every word."""
    line = " " + "".join(w + " " for w in license_templates.words_of(text))
    labels = set()
    for label, templates in notices.items():
        for template in templates:
            pattern = ""
            for part in re.split(r"(<<.*?>>)", template):
                if part == "<<beginOptional>>":
                    pattern += "(?:"
                elif part == "<<endOptional>>":
                    pattern += ")?"
                elif part.startswith("<<var"):
                    pattern += r"(?:[^ ]+ ){%s,%s}" % re.search(r"words=(\d+)-(\d+)", part).groups()
                else:
                    pattern += "".join(re.escape(w) + " " for w in license_templates.words_of(part))
            if re.search("(?<= )" + pattern, line):
                labels.add(label)
    return labels


def filled_in(template):
    return re.sub(r"<<var[^>]*>>", "Ann Example", re.sub(r"<<(begin|end)Optional>>", "", template))


def test_license_labels_equal_a_naive_matcher(spark, tables):
    """Every template written out, with and without its optional regions, some with a word changed or left out, and the table's texts."""
    rng, texts = np.random.default_rng(1), []
    for templates in license_templates.NOTICES.values():
        for template in templates:
            whole, short = filled_in(template), filled_in(re.sub(r"<<beginOptional>>[^<]*<<endOptional>>", "", template))
            words = whole.split()
            at = int(rng.integers(len(words)))
            texts += [f"see: {whole} ok", short, " ".join(words[:at] + words[at + 1 :]), " ".join([*words[:at], "other", *words[at + 1 :]]), whole[: len(whole) // 2]]
    texts += ["GNU Affero General Public License version 3", "GNU Lesser General Public License version 2.1", "licensed under Creative Commons 4.0", "Permission is hereby granted, free of charge", "any GNU General Public License, either version 3 of it"]
    texts += [r.text for r in tables[0].select("text").limit(300).collect()]
    got = license_templates.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id")
    base = {label: (phrase,) for phrase, label in license_templates.BASE_PHRASES.items()}
    for i, text in enumerate(texts):
        assert set(filter(None, got.labels[i].split(","))) == naive_labels(text, license_templates.NOTICES) | naive_labels(text, base), text
    labels = {texts[i]: got.labels[i] for i in range(len(texts))}
    assert labels["GNU Affero General Public License version 3"] == "agpl,agpl-3.0,gpl"
    assert labels["GNU Lesser General Public License version 2.1"] == "gpl,lgpl,lgpl-2.1" and labels["licensed under Creative Commons 4.0"] == ""


def test_notices_of_the_user(spark):
    docs = spark.createDataFrame([(1, "All rights reserved"), (2, "MIT License"), (3, "all rights are reserved")], "doc_id long, text string")
    own = {"arr": ("all rights reserved",), "arr-long": ("all rights <<beginOptional>>are<<endOptional>> reserved",)}
    assert {r.doc_id: r.labels for r in license_templates.license_scan(docs, notices=own).collect()} == {1: "arr,arr-long", 2: "mit", 3: "arr-long"}
    assert {r.doc_id: r.labels for r in license_templates.license_scan(docs, notices={}).collect()} == {1: "", 2: "mit", 3: ""}
    for bad in ("<<var;name=x;words=1-2>> a", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            license_templates.compiled("x", bad)


def test_license_cases(odd):
    docs, _ = odd
    got = license_templates.license_scan(docs)
    assert got.count() == len(CASES) and got.where("score = 0").count() == len(CASES)
    assert license_templates.license_scan(docs.limit(0)).count() == 0


def test_mixing_meets_targets(tables):
    docs, labels = tables
    weights = {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}
    got = mixing.mix(docs, labels, weights=weights).toPandas()
    assert len(got) == docs.count() and (got.rate >= 0).all() and (got.copies >= np.floor(got.rate)).all() and (got.copies <= np.ceil(got.rate)).all()
    tokens, posteriors = got.tokens.to_numpy(float), np.vstack(got.posteriors)
    shares = (posteriors * (tokens * got.rate.to_numpy())[:, None]).sum(0) / tokens.sum()
    assert np.abs(shares - [weights[d] for d in ("de", "en", "es", "fr")]).max() < 3e-3
    # The same minimum by brute force: every rate as a variable of its own.
    n = tokens / tokens.sum()
    target, rate = np.array([weights[d] for d in ("de", "en", "es", "fr")]), np.ones(len(n))
    for _ in range(4000):
        residual = (posteriors * (n * rate)[:, None]).sum(0) - target
        rate = np.maximum(0, rate - 1.2 * (posteriors @ residual + 1e-4 * (rate - 1)))
    assert np.abs(rate - got.rate).max() < 0.02
    texts = docs.toPandas().set_index("doc_id").text
    assert (got.set_index("doc_id").tokens == texts.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))).all()


def test_mixing_cases(odd):
    docs, labels = odd
    got = mixing.mix(docs, labels)
    assert got.count() == len(CASES) and got.where("copies >= 0 and rate >= 0").count() == len(CASES)
    assert mixing.mixed(docs, labels).columns == docs.columns
    assert mixing.mix(docs.limit(0), labels.limit(0)).count() == 0 and mixing.mixed(docs.limit(0), labels).count() == 0


def test_mixing_of_many_domains(spark, tables, monkeypatch):
    """More domains than the sums have columns, and rounds that go over written states, give the same rates."""
    docs, labels = tables
    plain = mixing.mix(docs, labels, weights={"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}).toPandas().set_index("doc_id")
    monkeypatch.setattr(mixing, "KEEP_ROUNDS", 2)
    kept = mixing.mix(docs, labels, weights={"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}).toPandas().set_index("doc_id")
    assert np.abs(plain.rate - kept.rate).max() < 1e-9
    monkeypatch.setattr(mixing, "KEEP_ROUNDS", 10)
    many = docs.limit(400).withColumn("lang", F.concat("lang", (F.col("doc_id") % 30).cast("string")))
    labels = docs.limit(400).selectExpr("doc_id", "1 as quality", "0 as toxic")
    got = mixing.mix(many, labels).toPandas()
    k = len(got.posteriors[0])
    assert k > mixing.COLUMN_DOMAINS and (got.rate >= 0).all()
    before, after = (np.abs(mixing.mixture_residual(spark.createDataFrame(got.assign(rate=r)[["tokens", "posteriors", "rate"]]), np.full(k, 1 / k))).max() for r in (1.0, got.rate))
    # The least residual that rates of 0 or more allow, by brute force.
    posteriors, n, rate = np.vstack(got.posteriors), (got.tokens / got.tokens.sum()).to_numpy(), np.ones(len(got))
    fast = 1 / np.linalg.eigvalsh((posteriors * n[:, None]).T @ posteriors)[-1]
    for _ in range(20_000):
        rate = np.maximum(0, rate - fast / 2 * (posteriors @ ((posteriors * (n * rate)[:, None]).sum(0) - 1 / k) + 1e-4 * (rate - 1)))
    least = np.abs((posteriors * (n * rate)[:, None]).sum(0) - 1 / k).max()
    assert after < before and abs(after - least) < 1e-3
    monkeypatch.setattr(mixing, "MOST_DOMAINS", 3)
    with pytest.raises(ValueError):
        mixing.mix(docs, labels)
