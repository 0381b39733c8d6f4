from mailtriage.llm import licence_rules as L
from tests.llm.conftest import ODD

MIT = """Some junk without an end
 
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""


def found(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [(r.licences, r.rules) for r in L.with_licences(df).orderBy("doc_id").collect()]


def test_rules(spark):
    got = found(
        spark, "ends oddly\nLicensed under the Apache License, Version 2.0.", "We say: Released under the MIT License. And on.\nReleased under the MIT License.", "not released under the mit license terms",
        MIT, MIT.replace("The above copyright notice", "No notice"), "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.", "a | b | Released under the MIT License.",
    )
    assert got[0] == (["apache-2.0"], ["apache-notice*1"])
    assert got[1] == (["mit"], ["mit-notice*2"])
    assert got[2] == ([], [])
    assert got[3] == (["mit"], ["mit-text*1"])
    assert got[4] == (["mit"], ["mit-grant*1"])
    assert got[5] == (["gpl-3.0-only", "cc-by-nc-4.0"], ["gpl-3-notice*1", "cc-by-nc-notice*1"])
    assert got[6][0] == []


def test_order_of_sentences_matters(spark):
    a, b, c = (L.SENTENCES[x] for x in ("bsd-grant", "bsd-source", "bsd-binary"))
    got = found(spark, f"{a}. {b}. {c}.", f"{b}. {a}. {c}.")
    assert got[0][0] == ["bsd-2-clause"] and got[1][0] == []


def test_what_stands_around_a_rule_does_not_meet(spark):
    assert found(spark, "Apache License.\n" + MIT + "\nVersion 2.0, January 2004.\n")[0] == (["mit"], ["mit-text*1"])
    assert found(spark, "Apache License.\nVersion 2.0, January 2004.\n" + MIT)[0][0] == ["mit", "apache-2.0"]


def test_sentences_far_apart_are_no_licence(spark):
    title, date = "GNU General Public License.", "Version 3, 29 June 2007."
    texts = [title + " Word." * n + " " + date for n in (0, L.GAP, L.GAP + 1, 5000)] + [f"{title}\n\n\n\n\n\n\n\n\n\n\n\n{date}"]
    assert [x[0] for x in found(spark, *texts)] == [["gpl-3.0"], ["gpl-3.0"], [], [], ["gpl-3.0"]]


def test_odd_rows(odd, none):
    got = L.with_licences(odd).collect()
    assert len(got) == len(ODD) and all(r.licences == [] and r.sentence_count == 0 for r in got)
    assert L.with_licences(none).count() == 0
