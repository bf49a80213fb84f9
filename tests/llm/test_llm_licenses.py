import math
import re
from collections import Counter

import pytest

from weblode.llm import licenses


def split(text):
    return [t for t in re.split(r"[^\w.]+|_+|\.(?!\d)|(?<!\d)\.", text.lower()) if t]


def brute(files, threshold=licenses.THRESHOLD):
    """(path, own licence, cosine, licence, via, from_dir) by looking at everything."""
    units = {}
    for n, (_, text) in enumerate(files):
        lines = [x for x in re.split(r"[\r\n]+", text or "") if re.search(licenses.TRIGGER, x)]
        units[n] = lines + (["\n".join(lines)] if len(lines) > 1 else [])
    every = [split(u) for us in units.values() for u in us]
    vocabulary = {t for ts in licenses.TEMPLATES.values() for x in ts for t in split(x)}
    seen = Counter(t for u in every for t in set(u) if t in vocabulary)
    idf = lambda t: math.log((1 + len(every)) / (1 + seen[t])) + 1 if t in vocabulary else math.log(1 + len(every)) + 1
    vector = lambda terms: {t: n * idf(t) for t, n in Counter(terms).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    goals = [(name, vector(split(x))) for name, xs in licenses.TEMPLATES.items() for x in xs]
    own = {}
    for n, us in units.items():
        scored = []
        for u in us:
            v = vector(split(u))
            scored += [(-round(sum(v.get(t, 0) * w for t, w in g.items()) / norm(v) / norm(g), 9), name) for name, g in goals if v]
        scored = [x for x in scored if -x[0] >= threshold]
        own[n] = min(scored) if scored else None
    folder = lambda path: path.rpartition("/")[0].rstrip("/")
    granted = {}
    for n, (path, _) in enumerate(files):
        if own[n] and re.match(licenses.LICENCE_FILE, (path or "").rpartition("/")[2]):
            granted.setdefault(folder(path or ""), []).append((*own[n], path))
    out = []
    for n, (path, _) in enumerate(files):
        at, found = folder(path or ""), None
        while own[n] is None:
            if at in granted:
                found = (min(granted[at])[1], at)
                break
            if not at:
                break
            at = folder(at)
        if own[n]:
            out.append((path, own[n][1], -own[n][0], own[n][1], "own", None))
        else:
            out.append((path, None, None, found and found[0], "inherited" if found else "none", found and found[1]))
    return sorted(out, key=repr)


def found(spark, files, **options):
    frame = spark.createDataFrame([(p, t, "x", 1) for p, t in files], "path string, text string, license string, file int")
    return sorted(map(tuple, licenses.scan(frame, **options).collect()), key=repr)


FILES = [
    ("a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("a/b/c/main.py", "import os\n"), ("a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/d/e/x.py", "y = 1"),
    ("a/z.py", "# SPDX-License-Identifier: Apache-2.0\ncode"), ("q/r.py", "nothing"), ("q/license-notes.py", "a license of some kind, we do not know which one it is"),
    ("LICENSE.md", "Licensed under CC BY-NC 4.0."), ("top.py", None), ("m/LICENSE", "Released under the MIT License."), ("m/LICENCE", "Released under the ISC License."),
    ("m/n/x", ""), (None, "Licensed under the Apache License, Version 2.0.\nCopyright someone"), (None, None), ("a/b/c/main.py", "import os\n"),
    ("long/x", "word " * 50_000 + "\nLicensed under CC BY 4.0.\n" + "word " * 50_000), ("/abs/LICENSE", "Released under the MIT License."), ("/abs/deep/er/f", "x"),
]


def test_against_brute_force(spark):
    got = found(spark, FILES)
    wanted = brute(FILES)
    assert [(g[0], *g[1:2], *g[3:]) for g in got] == [(w[0], *w[1:2], *w[3:]) for w in wanted]
    assert all(a[2] == pytest.approx(b[2], abs=1e-8) for a, b in zip(got, wanted) if b[2])
    by_path = {g[0]: g for g in got}
    assert by_path["a/b/c/d/e/x.py"][3:] == ("GPL-3.0", "inherited", "a/b") and by_path["q/r.py"][3:] == ("CC-BY-NC-4.0", "inherited", "")


def test_same_line_at_any_size(spark):
    """Cosine of a line with words besides the notice, alone or in all files, in corpora of one mix but different size."""
    mix = ["Licensed under the Apache License, Version 2.0."] * 7 + ["Released under the MIT License."] * 4 + ["All rights reserved."] * 4
    mix += ["This work is licensed under the GNU General Public License, version 3."] * 4 + ["Licensed under CC BY-NC 4.0."]
    for header in ("", "(c) Example Corp and others. "):
        cosines = []
        for n in (20, 260, 20_000):
            files = [(f"d{i}/x", header + mix[i % len(mix)]) for i in range(n)]
            files += [("alone/LICENSE", "(c) Acme. Released under the MIT License."), ("alone/y", "z")]
            by_path = {g[0]: g for g in found(spark, files)}
            assert by_path["alone/LICENSE"][1] == "MIT" and by_path["alone/y"][3:] == ("MIT", "inherited", "alone")
            assert by_path["d7/x"][1] == "MIT"
            cosines.append((by_path["alone/LICENSE"][2], by_path["d7/x"][2]))
        assert cosines[1] == pytest.approx(cosines[2], abs=0.05)


def test_empty_table(spark):
    assert found(spark, []) == [] and found(spark, [("a/b", "text without")]) == [("a/b", None, None, None, "none", None)]


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    files = [(r.path, r.text) for r in licenses.document_paths(docs).collect()]
    rows = licenses.op4_licenses(spark, folder).drop("doc_id").collect()
    assert [(r[0], r[1], r[3], r[4], r[5]) for r in sorted(map(tuple, rows), key=repr)] == [(w[0], w[1], w[3], w[4], w[5]) for w in brute(files)]
