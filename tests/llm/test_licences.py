import math
import textwrap

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from stacklight.llm import licences as L

#: Notices as they stand at the head of files (fixed values).
USUAL = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd": "Copyright (c) 2019 A. Author.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-sa": "The text of this page is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


@pytest.fixture(scope="module")
def scanner(spark):
    return L.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_wrapped_notices(spark, scanner):
    assert scanner.held_out > 0.95 and scanner.scale > 0
    rows, want = [], []
    for family, text in USUAL.items():
        for width in (45, 72, 80):
            for mark in ("", " * ", "# "):
                lines = [mark + x for part in text.split("\n") for x in (textwrap.wrap(part, width) or [""])]
                rows.append((len(rows), "\n".join(["Some prose came first of all.", *lines, "", "int main(void) {"])))
                want.append([family])
    long = " ".join(f"word{k}" for k in range(400))
    rows.append((len(rows), f"{long} Released under the MIT License. {long}"))
    want.append(["mit"])
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string"), scanner).collect()
    assert {r.doc_id: [x.family for x in r.licences] for r in got} == dict(enumerate(want))


def _plain(text, s, templates):
    """The scan in plain Python: (paragraph, family) of each notice."""
    known = {h for ts in templates.values() for t in ts for h in t}
    h64 = lambda x, seed=42: xxhash.xxh64_intdigest(x.encode(), seed & (2**64 - 1))
    signed = lambda h: h - 2**64 if h >= 2**63 else h

    def pairs(w):
        return {signed(h64(b, h64(a))) for a, b in zip(w, w[1:])}

    def judged(w):
        k = len(s.families)
        feats = {f % L.DIMENSION for f in pairs(w) | {signed(h64(x)) for x in w}}
        rows = [s.row[f] for f in feats if s.row[f] > 0]
        z = [s.intercepts[j] + sum(s.weights[r * k + j] for r in rows) for j in range(k)]
        best = max(range(1, k), key=lambda j: z[j])
        p = 1 / (1 + math.exp(-(s.scale * (z[best] - z[0]) + s.shift)))
        alike = max(len(pairs(w) & set(t)) / len(t) for t in templates[s.families[best]])
        return (p >= L.PROBABLE and alike >= L.ALIKE, p, alike, s.families[best])

    def told(w):
        starts = range(0, max(len(w) - L.WINDOW // 2, 1), L.WINDOW // 2)
        return max(judged(w[i : i + L.WINDOW]) for i in starts)

    lines = (text or "").split("\n")
    w = [[x for x in regex.split(r"[^\p{L}\p{N}]+", x.lower()) if x] for x in lines]
    one = [told(x) for x in w]
    short = [x if len(line) <= L.WRAPPED else [] for x, line in zip(w, lines)]
    over = [None] * len(lines)
    for i in range(len(lines) - 1):
        if short[i] and pairs(w[i]) & known and not one[i][0]:
            over[i] = told(sum(short[i : i + L.LINES], []))
    same = lambda x, f: x is not None and x[0] and x[3] == f
    out = []
    for i, b in enumerate(over):
        if one[i][0]:
            out.append((i, one[i][3]))
        elif b is not None and b[0] and not any(same(x, b[3]) for x in one[i : i + L.LINES]):
            after, before = over[i + 1 : i + L.LINES], over[max(i - L.LINES + 1, 0) : i]
            if not any(same(x, b[3]) and x[2] >= b[2] for x in after) and not any(same(x, b[3]) and x[2] > b[2] for x in before):
                out.append((i, b[3]))
    return out


def test_scan_equals_plain_version(spark, scanner):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["\n".join(textwrap.wrap(t, 50)) for t in USUAL.values()] + ["\n\n".join(textwrap.wrap(" ".join(USUAL.values()), 70)), None, "", "\n", "the terms of the\n" * 30]
    got = L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scanner).collect()
    templates = L.template_pairs(spark)
    assert {r.doc_id: [(x.paragraph, x.family) for x in r.licences] for r in got} == {k: _plain(t, scanner, templates) for k, t in enumerate(texts)}


def test_families_and_look_alikes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scanner = L.train(docs)
    told = [(f, t) for f, ts in L.TEMPLATES.items() for t in ts]
    rows = [(k, "Some prose first.\n" + t + "\nand a last line") for k, (_, t) in enumerate(told)]
    plain = ["the license of the driver", "rights", None, "", "\n\n", "x " * 50000, "He was released under the bridge.", "Licensed under", "This work is about the general public."]
    rows += [(1000 + k, t) for k, t in enumerate(plain)] + [(None, told[0][1]), (1, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("paragraph", F.lit(1)).withColumn("family", F.lit("x"))
    got = L.scan(df, scanner).collect()
    assert len(got) == len(rows)
    right = 0
    for r in got:
        if r.doc_id is None:
            assert [x.family for x in r.licences] == [told[0][0]]
        elif r.doc_id < 1000:
            assert all(x.paragraph == 1 and x.alike >= L.ALIKE for x in r.licences)
            right += [x.family for x in r.licences] == [told[r.doc_id][0]]
        else:
            assert r.licences == []
    assert right >= 0.9 * (len(told) + 1)
    assert L.scan(df.limit(0), scanner).count() == 0


def test_query_finds_each_notice(spark):
    sf = "/root/testdata/sf0.01"
    notices = {"gpl-3.0": "GNU General Public License, version 3", "mit": "Released under the MIT License.", "cc-by-nc": "CC BY-NC 4.0", "apache-2.0": "Apache License, Version 2.0", "proprietary": "All rights reserved."}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in L.op6_licences(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        assert got[i].families == ",".join(sorted(f for f, n in notices.items() if n in t))
        assert got[i].n_paragraphs == t.count("\n") + 1


def test_no_python_on_the_executors(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = L.scan(docs, L.Scanner(["unknown", *L.TEMPLATES], [0.0] * (1 + len(L.TEMPLATES)), [0] * L.DIMENSION, [0.0] * (1 + len(L.TEMPLATES))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
