import re

from corpus_rows import ODD, documents

from skillscope.llm import licences



def slow(rows, threshold):
    grams = [(name, k, {f"{a} {b}" for a, b in zip(w, w[1:])}) for name, texts in licences.TEMPLATES.items()
             for k, t in enumerate(texts) for w in [re.sub(r"[\W_]+", " ", t.lower()).split()]]
    most = max(max(licences.size_range(len(g), threshold)) for *_, g in grams)
    out = []
    for i, text in rows:
        lines = [re.sub(r"[\W_]+", " ", x.lower()).split() for x in (text or "").split("\n")]
        units = list(enumerate(lines))
        if len(lines) > 1 and sum(map(len, lines)) <= most + 1:
            units.append((licences.WHOLE, sum(lines, [])))
        for u, words in units:
            g = {f"{a} {b}" for a, b in zip(words, words[1:])}
            for name, k, t in grams:
                if g and 2 * len(g & t) / (len(g) + len(t)) >= threshold:
                    out.append((i, u, name, k, len(g), round(2 * len(g & t) / (len(g) + len(t)), 6)))
    return sorted(out, key=str)


def test_scan_equals_all_pairs(spark, small):
    mit = licences.TEMPLATES["MIT"][3]
    extra = [(900, "prose\n" + mit.upper() + "\nprose"), (901, "\n".join(re.findall(r"(?:\S+\s*){1,6}", mit))),
             (902, mit.replace("free of charge", "gratis").replace("sublicense", "x")), (903, "released under the mit licence")]
    rows = [(r[0], r[1]) for r in ODD] + small + extra
    got = licences.scan(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.unit, r.licence, r.template, r.n_bigrams, round(r.dice, 6)) for r in got), key=str) == \
        slow(rows, licences.THRESHOLD)
    assert {901, 900, 902} <= {r.doc_id for r in got}


def test_size_bounds_are_exact():
    for size in range(1, 60):
        able = {n for n in range(1, 120) if 2 * min(n, size) / (n + size) >= 0.8}
        assert set(licences.size_range(size, 0.8)) == able


def test_empty_table_and_no_python(spark, none):
    found = licences.scan(none)
    assert found.count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_passages_in_long_texts_are_found(spark):
    prose = "\n".join(" ".join(f"w{i}x{j}" for j in range(11)) for i in range(40))
    mit, isc = licences.TEMPLATES["MIT"][3], licences.TEMPLATES["ISC"][0]
    wrap = lambda t: "\n".join(re.findall(r"(?:\S+\s*){1,11}", t))
    rows = [(1, f"{prose}\n{wrap(mit)}\n{prose}"), (2, f"{wrap(isc)}\n\n{prose}\n{wrap(isc)}"),
            (3, prose.replace("\n", " ") + " it is Licensed under the Apache License, Version 2.0. " + prose),
            (4, prose + "\n" + mit + "\n" + prose), (5, prose + " software license permission of the software"),
            (6, f"{prose}\n{wrap(mit)} {wrap(mit)}")]
    got = licences.scan(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.unit, r.licence, r.template, round(r.dice, 6)) for r in got if r.template != 1 or r.doc_id != 3) == [
        (1, 40, "MIT", 3, 1.0), (2, 0, "ISC", 0, 1.0), (2, 44, "ISC", 0, 1.0), (3, 0, "Apache-2.0", 0, 1.0),
        (4, 40, "MIT", 3, 1.0), (6, 40, "MIT", 3, 1.0), (6, 45, "MIT", 3, 1.0)]


def test_telling_words_are_in_every_match():
    rows = licences.template_bigrams(licences.TEMPLATES)
    words = set(licences.telling_words(rows, 0.8))
    assert not words & licences.COMMON
    for *_, grams in rows:
        assert sum(not words & set(g.split()) for g in grams) < licences.least_shared(len(grams), 0.8)
