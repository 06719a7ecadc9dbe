from lodestone.llm import licenses as L


def test_families_unknown_and_edge_rows(spark):
    m = L.trained()
    assert m.accuracy > 0.9
    lines = {t: f for f, ts in L.TEMPLATES.items() for t in ts}
    docs = [(k, "Plain words first.\n" + t + "\nand the end") for k, t in enumerate(lines)]
    other = [(100, None), (101, ""), (102, "The driver renewed the license of the car."), (103, "no cue here " * 20000), (None, "Released under the MIT License."), (104, "RELEASED UNDER THE MIT LICENSE\nplain\nReleased under the MIT License.")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs + other], "doc_id long, text string, family string, line int")
    got = [r for r in L.scan(df).collect()]
    by = {r.doc_id: r for r in got if r.line == 1}
    right = [by[k].family == f for k, f in enumerate(lines.values())]
    assert sum(right) >= 0.95 * len(right)
    assert all(by[k].confirmed and by[k].similarity == 1 for k, ok in enumerate(right) if ok)
    assert not [r for r in got if r.doc_id in (100, 101, 103)]
    assert [r.confirmed for r in got if r.doc_id == 102] == [False]
    assert sorted(r.line for r in got if r.doc_id == 104 and r.family == "mit") == [0, 2]
    assert [r.family for r in got if r.doc_id is None] == ["mit"]
    assert L.scan(df.limit(0)).count() == 0


def test_scores_equal_numpy(spark):
    import numpy as np

    m = L.trained()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.line): r for r in L.scan(docs).collect()}
    assert len(got) > 5
    number = {g: k for k, g in enumerate(m.vocabulary)}
    seen = 0
    for r in docs.collect():
        for k, line in enumerate(r.text.split("\n")):
            grams = [number[g] for g in L.ngrams(L.tokens(line)) if g in number]
            assert ((r.doc_id, k) in got) == bool(grams)
            if grams:
                p = L._softmax((m.weights[grams].sum(axis=0) + m.bias)[None])[0]
                assert abs(p.max() - got[r.doc_id, k].probability) < 1e-9
                seen += 1
                if line in ("Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0."):
                    assert got[r.doc_id, k].confirmed and got[r.doc_id, k].family == {"R": "mit", "L": "cc-by-nc" if "CC" in line else "apache-2.0"}[line[0]]
    assert seen == len(got)


def test_the_plan_runs_no_python(spark):
    plan = L.op6_licenses(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD = """Copyright (c) 2020, Someone

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
   \r
1. Redistributions of source code must retain the above copyright notice."""


def test_wrapped_notices_are_confirmed(spark):
    prose = "\n".join("the people of the town use it under the general terms and any person may copy the license" for _ in range(30))
    df = spark.createDataFrame([(1, MIT), (2, BSD), (3, prose), (4, None), (5, "\n\n")], "doc_id long, text string")
    got = L.scan(df, paragraphs=True).collect()
    whole = {(r.doc_id, r.line, r.last_line, r.family) for r in got if r.confirmed and r.last_line > r.line}
    assert whole == {(1, 4, 9, "mit"), (2, 2, 3, "bsd")}
    assert not [r for r in got if r.doc_id > 3]
    lines = [tuple(r) for r in got if r.last_line == r.line]
    assert sorted(lines) == sorted(map(tuple, L.scan(df).collect()))


# Notices in other words than the templates and the calibration texts have.
HELD_OUT = [
    ("apache-2.0", "Source code is provided under the Apache 2.0 License."), ("apache-2.0", "Licensed to you under the Apache License Version 2.0"),
    ("mit", "Everything here is released under the MIT License (see COPYING)."), ("mit", "This tool is distributed under the MIT license."),
    ("gpl", "It may be distributed under the terms of the GNU General Public License, version 2."), ("gpl", "The driver is licensed under GPL version 3"),
    ("lgpl", "GNU Lesser General Public License 2.1"), ("lgpl", "It is released under the GNU Lesser General Public License."),
    ("agpl", "The whole thing is under the GNU Affero General Public License version 3."),
    ("bsd", "Released under the BSD license."), ("bsd", "The 3-clause BSD license applies."),
    ("isc", "Code is released under the ISC License."), ("epl-2.0", "Available under the Eclipse Public License 2.0."),
    ("mpl-2.0", "This file is subject to the Mozilla Public License, v. 2.0."), ("unlicense", "The code is released under the Unlicense."),
    ("cc-by", "This article is licensed under a Creative Commons Attribution 4.0 International License."), ("cc-by", "Content licensed under CC BY 4.0"),
    ("cc-by-sa", "Pictures are licensed under CC BY-SA 4.0."), ("cc-by-nc", "Texts licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "(c) 2020 The Press, all rights reserved."),
    ("unknown", "The fishing license costs ten crowns a year."), ("unknown", "He spoke with the permission of the chair."), ("unknown", "Wir fahren mit dem Rad und mit dem Copyright-Anwalt."),
    ("unknown", "Die reserved Plätze sind mit Karten belegt."), ("unknown", "Sa licence de conducteur a été retirée."), ("unknown", "La permission est accordée par le maire."),
    ("unknown", "Pidió la licencia de caza con el licenciado."), ("unknown", "The warranty was granted by the seller."), ("unknown", "This term of the license is unclear."),
]


def test_held_out_notices_and_running_text_of_four_languages(spark):
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(HELD_OUT)], "doc_id long, text string")
    got = {r.doc_id: r.family for r in L.scan(docs).collect()}
    guess = [got.get(k, "unknown") for k in range(len(HELD_OUT))]
    truth = [f for f, _ in HELD_OUT]
    named = [(g, f) for g, f in zip(guess, truth) if g != "unknown"]
    precision, recall = sum(g == f for g, f in named) / len(named), sum(g == f != "unknown" for g, f in zip(guess, truth)) / sum(f != "unknown" for f in truth)
    print(precision, recall, [(g, f, t) for g, f, (_, t) in zip(guess, truth, HELD_OUT) if g != f])
    assert precision > 0.9 and recall > 0.9


def test_planted_notices_and_german_lines(spark):
    planted = {"This work is licensed under the GNU General Public License, version 3.": "gpl", "All rights reserved.": "all-rights-reserved", "Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache-2.0"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.line): (r.family, r.confirmed) for r in L.op6_licenses(spark, "/root/testdata/sf0.01").collect() if r.line == r.last_line}
    want = {(r.doc_id, k): (planted[line.strip()], True) for r in docs.collect() for k, line in enumerate((r.text or "").split("\n")) if line.strip() in planted}
    assert len(want) > 10 and {k: got.get(k) for k in want} == want
    assert not [k for k, v in got.items() if k not in want and v[0] != "unknown"]
    german = spark.createDataFrame([(1, "Wir kommen mit dem Zug und mit den Kindern mit."), (2, "word " * 200_000 + "license")], "doc_id long, text string")
    assert [(r.doc_id, r.family) for r in L.scan(german, paragraphs=True).collect()] == [(2, "unknown")]


def test_the_family_must_have_the_closest_template(spark):
    docs = spark.createDataFrame([(1, "Licensed under the GNU Lesser General Public License, version 2.1."), (2, "Licensed under the GPL version 2 or later.")], "doc_id long, text string")
    got = {r.doc_id: (r.family, r.template_family, r.confirmed) for r in L.scan(docs).collect()}
    assert got == {1: ("lgpl", "lgpl", True), 2: ("gpl", "gpl", True)}


def test_the_plan_has_no_exchange(spark):
    plan = L.op6_licenses(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan
