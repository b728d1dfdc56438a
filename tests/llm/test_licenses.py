"""Base phrases and the positional index against plain Python."""
import math
import random
import re
from collections import Counter, defaultdict

from labelbench.llm import licenses
from labelbench.llm.tables import read

from conftest import SF01


def split(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def frequencies(rows, templates):
    lists = [split(t) for _, t in rows]
    vocabulary = {w for _, t, _ in templates for w in t.split()}
    df = Counter(w for words in lists for w in set(words) & vocabulary)
    return {w: math.log((len(rows) + 1) / (df[w] + 1)) + 1 for w in vocabulary}


def brute(rows, templates=licenses.TEMPLATES):
    """Every template in every document: the rarest of its words there vote at every place."""
    idf = frequencies(rows, templates)
    out = []
    for i, text in rows:
        words = split(text)
        starts, base = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            found = [s for s in range(len(words) - len(p) + 1) if words[s:s + len(p)] == p]
            starts += found
            base |= {label} if found else set()
        labels, best = set(base), 0.0
        for label, notice, keys in templates:
            own = notice.split()
            ranked = sorted(set(own), key=lambda w: (-idf[w], w))
            rarest = [w for w in ranked if w in words][:licenses.LOOKED_UP]
            votes = defaultdict(set)
            for at, w in enumerate(words):
                if w in rarest:
                    for p, v in enumerate(own):
                        if v == w:
                            votes[at - p].add(w)
            total = sum(idf[w] for w in ranked[:licenses.LOOKED_UP])
            share = max((sum(idf[w] for w in s) / total for s in votes.values()), default=0)
            if share >= licenses.SHARE and any(f" {k} " in f" {' '.join(words)} " for k in keys):
                labels.add(label)
                best = max(best, min(1.0, share))
        out.append((i, len(words), len(starts), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else best))
    return out


CASES = [
    None, "", " ... ", "plain words of nothing much", "Released under the MIT License.", "MIT-License, mit  license; MIT\nLICENSE",
    "x GNU General Public License GNU GENERAL public license", "gnu general public", "licensed under CC BY-NC 4.0", "cc by by cc by",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "intro é ü text. Redistribution and use in source and binary forms, with or without modification, are permitted",
    "redistribution forms binary source use and in", "Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. Licensed under the",
    "All rights reserved.", "rights reserved all", "This is free and unencumbered software released into the public domain " * 3,
    "A\x00b\x7Fc 9z_8 \x1f日本 K",
]


def _same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:3])
    got, want = sorted((tuple(x) for x in got), key=key), sorted(want, key=key)
    assert [r[:7] for r in got] == [r[:7] for r in want]
    assert all(abs(a[7] - b[7]) < 1e-6 for a, b in zip(got, want))


def test_cases(spark):
    filler = ["some filler words the of and in %d" % i for i in range(60)]
    rows = [(i, t) for i, t in enumerate(CASES + filler)]
    rows += [rows[4], (None, CASES[4]), (None, "cc by"), (3, CASES[10])]
    docs = spark.createDataFrame([(i, t, "w") for i, t in rows], "doc_id long, text string, labels string")
    out = licenses.scan(docs)
    _same(out.collect(), brute(rows))
    by_id = {x.doc_id: x.labels for x in out.collect()}
    assert by_id[10] == "mit" and by_id[11] == "bsd" and by_id[12] == "" and by_id[14] == "all-rights-reserved" and by_id[16] == "unlicense"


def test_given_table(spark):
    docs = read(spark, SF01, "documents")
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    _same(licenses.scan(docs).collect(), brute(rows))


def test_empty_table_and_no_python(spark):
    out = licenses.scan(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0
    plan = licenses.scan(read(spark, SF01, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_frequent_licence(spark):
    """A notice that stands in a third of the documents, and one in all of them, are labelled there."""
    notices = {label: text for label, text, _ in licenses.TEMPLATES if label in ("bsd", "cc0", "all-rights-reserved")}
    for label, text in notices.items():
        for every in (3, 1):
            rows = [(i, f"file {i} {text} code" if i % every == 0 else f"plain text {i}") for i in range(60)]
            out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
            assert {x.doc_id: x.labels for x in out} == {i: label if i % every == 0 else "" for i in range(60)}
            assert all(abs(x.score - (x.doc_id % every == 0)) < 1e-6 for x in out)


def test_several_notices_in_one_text(spark):
    """Any two notices, all of them, and all of them far apart in a long text: no label is lost."""
    texts = [(a[1] + " filler " + b[1], {a[0], b[0]}) for a in licenses.TEMPLATES for b in licenses.TEMPLATES if a[0] != b[0]]
    everything = {t[0] for t in licenses.TEMPLATES}
    texts += [(" and so on ".join(t[1] for t in licenses.TEMPLATES), everything)]
    texts += [((" the use of this code and of any other copy " * 500).join(t[1] for t in licenses.TEMPLATES), everything)]
    texts += [("plain words %d" % i, set()) for i in range(2000)]
    out = licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")).collect()
    assert len(out) == len(texts)
    for x in out:
        assert texts[x.doc_id][1] <= set(x.labels.split(",") if x.labels else [])
        assert texts[x.doc_id][1] or not x.labels


def test_rare_words_lose_nothing():
    """Whatever weighs enough holds a rare word, and one rare word fewer would not do."""
    for frequent in ([], ["software", "license", "the"], sorted({w for _, t, _ in licenses.TEMPLATES for w in t.split()})):
        rows = [(i, " ".join(frequent) if i % 2 else "x") for i in range(50)]
        idf = frequencies(rows, licenses.TEMPLATES)
        for _, text, _ in licenses.TEMPLATES:
            ranked, rare = licenses.by_rarity(text, idf), licenses.rare_words(text, idf)
            weigh = lambda ws: sum(idf[w] for w in ws[:licenses.LOOKED_UP])
            assert ranked[:len(rare)] == rare
            assert weigh(ranked[len(rare):]) < licenses.SHARE * weigh(ranked)
            assert len(rare) == 1 or weigh(ranked[len(rare) - 1:]) >= licenses.SHARE * weigh(ranked) - 1e-5


def test_parts_of_notices_and_given_templates(spark):
    """Notices with words left out, swapped or added, key phrases alone, and templates of the caller's own."""
    rng = random.Random(3)
    own = licenses.TEMPLATES + [("house", "internal use only within the example house rules", ["internal use only"]), ("one", "zyzzyva", ["zyzzyva"])]
    rows = []
    for _, text, keys in own * 6:
        notice = text.split()
        for _ in range(rng.randrange(1, 8)):
            at = rng.randrange(len(notice))
            notice[at:at + 1] = rng.choice([[], [notice[at], "word"], [rng.choice(text.split())]])
            notice = notice or ["word"]
        rows.append((len(rows), " ".join(notice)))
        rows.append((len(rows), f"{keys[0]} and {' '.join(reversed(text.split()))}"))
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), own).collect()
    _same(out, brute(rows, own))
    assert {"house", "one"} <= {label for x in out for label in x.labels.split(",")}
