import re

from procframe.llm import license_rules, licenses

JOINED = [
    ("Licensed under GPL3.", "gpl-3"), ("licensed under the GPL2", "gpl-2"), ("released under GPLv3", "gpl-3"), ("Licensed under the GNU GPLv2+", "gpl-2"), ("SPDX-License-Identifier: GPLv 2", "gpl-2"), ("licensed under the LGPLv3", "lgpl"),
    ("licensed under LGPLv2.1", "lgpl"), ("licensed under LGPL2.1", "lgpl"), ("available under the AGPLv3", "agpl"), ("the AGPL3 license", "agpl"), ("licensed under the GPL v3", "gpl-3"), ("license GPL version 2", "gpl-2"), ("all gplv4 here", ""),
]


def test_versions_joined_on(spark):
    docs = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(JOINED)], "doc_id long, text string")
    assert [r.labels for r in licenses.scan(docs).orderBy("doc_id").collect()] == [label for _, label in JOINED]


def test_the_gate_changes_nothing(spark):
    names = ["gpl", "lgpl", "agpl", "gnu gpl", "apache", "bsd", "mpl", "cc by nc", "cddl", "eupl"]
    texts = [x for x, _ in JOINED] + [form.format(f"{name}{v}") for name in names for v in ("", "2", "v2", "V3", " v3", "3", " 2.0", " version 3", "-2-clause") for form in ("Licensed under the {}.", "{} license", "xyz under terms of {}")]
    docs = spark.createDataFrame(list(enumerate([*texts, None, "", "all rights reserved"])), "doc_id long, text string")
    assert licenses.scan(docs).orderBy("doc_id").collect() == licenses.scan(docs, gated=False).orderBy("doc_id").collect()


def least(regex):
    """The shortest text that a rule's regex matches, about: optional parts left out, first alternatives taken."""
    text = regex.replace(".{1,80}?", "x").replace("[0-9 ]{4,16}", "2000 ").replace("[0-9]{2}", "99")
    while True:
        new = re.sub(r"\(\?:[^()]*\)\?", "", text)
        if new == text:
            break
        text = new
    text = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)", r"\1", text)
    return re.sub(r".\?", "", re.sub(r"\[(.)[^\]]*\]", r"\1", text))


def test_keywords_are_necessary():
    assert len(license_rules.RULES) > 200
    for _, _, _, keywords, regex in license_rules.RULES:
        text = least(regex)
        assert re.fullmatch(regex, text), (regex, text)
        words = {licenses.JOINED.get(w, w) for w in text.split()}
        assert set(keywords.split()) <= words, (regex, text, keywords)


def test_every_rule_fires(spark):
    texts = [least(x) for *_, x in license_rules.RULES]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.scan(docs).orderBy("doc_id").collect()
    assert got == licenses.scan(docs, gated=False).orderBy("doc_id").collect()
    assert all(r.labels and r.score > 0 for r in got)
    # a rule of priority 0 or 1 that spans its whole text keeps its label
    assert all(rule[2] in r.labels.split(",") for rule, r in zip(license_rules.RULES, got, strict=True) if rule[0] < 2)
