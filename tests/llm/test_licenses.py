import random

import numpy as np

from stratigraph.llm import license_scan
from stratigraph.llm.license_scan import LEAST_SCORE, SLACK, build_index, scan_file, scan_licenses
from stratigraph.llm.license_texts import BASE, TEMPLATES, WHOLE

from . import common

ROWS = common.AWKWARD + [
    (20, "x Licensed under the Apache License, Version 2.0 (the License) y", "", "", 0),
    (21, "gnu gnu general public license gnu general public\nlicense version 3. Licensed under CC BY-NC 4.0.", "", "", 0),
    (22, TEMPLATES["mit-text"][0].replace("any person", "any lovely person") + " " + "filler " * 3000 + TEMPLATES["bsd"][0], "", "", 0),
    (23, "the gnu people wrote a general remark on public matters and a license", "", "", 0),
    (24, "mit " * 2000 + "mit license " * 500, "", "", 0),
]


def brute(row):
    w = common.words(row[1], common.ALNUM)
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return (row[0], len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def test_scan(spark):
    got = scan_licenses(common.docs(spark, ROWS)).collect()
    key = lambda x: (x[0] is None, x[:3])
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(map(brute, ROWS), key=key)
    labels = {r.doc_id: r for r in got}
    assert labels[20].labels == "apache,apache-2.0" and labels[20].score == 1.0
    assert labels[21].labels == "cc-by,cc-by-nc,gpl"  # the GPL's name is there, too little of its notice
    assert labels[22].labels == "bsd,mit-text" and labels[22].score == 1.0
    assert labels[23].labels == "" and labels[23].score == 0
    assert labels[24].n_base == 500
    assert scan_licenses(common.docs(spark, [])).count() == 0


def test_no_template_hides_another(spark):
    names = ("isc", "unlicense", "mpl-2.0", "bsd")
    notices = "\n".join(TEMPLATES[n][0] for n in names) + "\nReleased under the MIT License"
    rows = [(i, "Released under the MIT License", "", "", 0) for i in range(30)] + [(100, notices, "", "", 0)]
    labels = {r.doc_id: r.labels for r in scan_licenses(common.docs(spark, rows)).collect()}
    assert labels[100] == ",".join(sorted([*names, "mit", "mit-notice"])) and labels[0] == "mit,mit-notice"


def plain_labels(text):
    """{label: score} by looking for every phrase of every template at every word."""
    w, out = common.words(text, common.ALNUM), {}
    stands = lambda phrase: [i for i in range(len(w)) if w[i : i + len(phrase)] == phrase]
    out |= {label: 1.0 for phrase, label in BASE.items() if stands(phrase.split())}
    for label, (told, phrases) in TEMPLATES.items():
        words = common.words(told, common.ALNUM)
        starts = []
        for phrase in phrases:
            p = phrase.split()
            inside = [q for q in range(len(words)) if words[q : q + len(p)] == p]
            starts.append({i - q for i in stands(p) for q in inside})
        fewest = min(starts, key=len)
        best = 0.0
        for d in fewest:
            if all(any(abs(x - d) <= len(words) for x in s) for s in starts):
                found, at = 0, d
                for q, x in enumerate(words):
                    near = [s for s in sorted(range(-SLACK, SLACK + 1), key=lambda s: (abs(s), -s)) if 0 <= at + q + s < len(w) and w[at + q + s] == x]
                    if near:
                        found, at = found + 1, at + near[0]
                best = max(best, found / len(words))
        if best >= LEAST_SCORE:
            out[label] = best
    return out


def mangled(g, text, rate):
    return " ".join(x for word in text.split() for x in ([] if g.random() < rate else [word] if g.random() > rate else [word, g.choice(["the", "of", "software", "zebra"])]))


def test_labels_and_scores_as_plain(spark):
    g = random.Random(8)
    rows = list(ROWS)
    for k in range(60):
        parts = [mangled(g, TEMPLATES[g.choice(list(TEMPLATES))][0], g.choice([0, 0, 0.02, 0.06, 0.15])) for _ in range(g.choice([1, 2, 4]))]
        rows.append((1000 + k, "\n".join(" ".join(g.choices(["the", "license", "of", "software", "x", "gnu", "mit"], k=g.randrange(30))) + " " + p for p in parts), "", "", 0))
    got = {r.doc_id: r for r in scan_licenses(common.docs(spark, [r for r in rows if r[0] is not None and r[0] != 9])).collect()}
    for r in rows:
        if r[0] in got:
            want = plain_labels(r[1])
            assert got[r[0]].labels == ",".join(sorted(want)), r[0]
            assert abs(got[r[0]].score - max(want.values(), default=0.0)) < 1e-12
    assert sum(x in r.labels.split(",") for r in got.values() for x in WHOLE) > 30


def test_mentions_are_no_licences(spark):
    rows = [(1, "we compare cc by nc with others", "", "", 0), (2, "nobody likes the gnu general public license version", "", "", 0)]
    assert {r.doc_id: r.labels for r in scan_licenses(common.docs(spark, rows)).collect()} == {1: "cc-by", 2: "gpl"}


def test_a_file_of_all_templates_keeps_all_labels(spark):
    rows = [(1, "\n\n".join(t for t, _ in TEMPLATES.values()), "", "", 0)]
    assert set(scan_licenses(common.docs(spark, rows)).first().labels.split(",")) == {*TEMPLATES, *BASE.values()}


def test_cost_does_not_go_by_the_number_of_templates(monkeypatch):
    g = random.Random(1)
    more = {f"t{i}": (" ".join(f"w{g.randrange(5000)}" for _ in range(30)) + f" key{i} word{i} of the software", (f"key{i} word{i}",)) for i in range(3000)}
    calls = []
    plain = license_scan._stands
    monkeypatch.setattr(license_scan, "_stands", lambda *a: calls.append(1) or plain(*a))
    seen = []
    for templates in (TEMPLATES, TEMPLATES | more):
        index = build_index(templates)
        index.idf = {int(w): 1.0 + int(w) % 7 for w in index.vocabulary}
        index.idf |= {int(h): 0.5 for h in license_scan._hashes("the of software license")}
        license_scan._posted(index)
        text = license_scan._hashes(" ".join([TEMPLATES["mit-whole"][0], TEMPLATES["isc"][0], "w1 w2 w3 the of software " * 50]))
        at = np.flatnonzero(np.isin(text, index.vocabulary))
        calls.clear()
        _, scores = scan_file(index, at.tolist(), text[at].tolist())
        seen.append((len(calls), "mit-whole" in scores, "isc" in scores))
    assert seen[0] == seen[1] and seen[0][1] and seen[0][2]
