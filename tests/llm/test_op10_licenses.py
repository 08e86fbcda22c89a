import os
import random
import re
import textwrap

import duckdb
import pytest

from sheetloom.llm import licenses, queries


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op10_license_sentences"]).fetchall()
    rows = sorted(map(tuple, queries.op10_license_sentences(spark, sf_dir).collect()))
    assert rows == sorted(want) and any(r[3] for r in rows)


def found(spark, *texts):
    rows = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    return [r.licenses for r in rows]


def test_rules_take_runs_in_order(spark):
    s = licenses.SENTENCES
    mit = "\n".join([s["mit-grant"], "", s["mit-keep"], "", s["mit-as-is"], s["mit-liable"]]).replace("software", "software\n  ")
    gpl = " ".join(s[k] for k in ("gpl-free", "gpl3-later", "gpl-hope", "gpl-implied", "gpl-details"))
    bsd = "\n".join([s["bsd-allow"], "1. " + s["bsd-source"], "2. " + s["bsd-binary"]])
    bsd3 = bsd + "\n3. " + s["bsd-names"]
    split = s["bsd-allow"] + " Something else. " + s["bsd-source"] + " " + s["bsd-binary"]
    apache = " ".join(s[k] for k in ("apache-grant", "apache-comply"))
    assert found(spark, mit, gpl, bsd, bsd3, split, apache, mit + "\n" + gpl) == ["MIT", "GPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "", "Apache-2.0", "GPL-3.0-or-later,MIT"]


def test_lines_without_a_full_stop_before(spark):
    assert found(spark, "a table | of words\nReleased under the MIT License.\nmore", "x\nLICENSED under CC by-nc 4.0") == ["MIT", "CC-BY-NC-4.0"]


def test_odd_rows(odd_docs, no_docs):
    rows = licenses.license_scan(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[18].licenses == "MIT" and by[18].statements == ["MIT"] * 4 and by[18].n_known == 2
    assert (by[0].n_sentences, by[1].n_sentences, by[2].n_sentences) == (0, 0, 0)
    assert licenses.license_scan(no_docs).count() == 0


def test_sentences_are_single(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(list(licenses.SENTENCES.items()), "k string, s string").select("k", licenses.identifiers(F.col("s"), licenses.SENTENCE_END).alias("i")).collect()
    assert all(r.i == [r.k] for r in rows)
    assert {i for _, run in licenses.RULES for i in run} <= {*licenses.SENTENCES, *(i for i, _ in licenses.HOLES)}


def test_wrapped_numbered_clauses(spark):
    s = licenses.SENTENCES
    wrap = lambda n, k: textwrap.fill(f"{n}. {s[k]}", 79, subsequent_indent="   ")
    bsd = [textwrap.fill(s["bsd-allow"], 79), wrap(1, "bsd-source"), wrap(2, "bsd-binary")]
    bsd3 = [*bsd, wrap(3, "bsd-names")]
    comment = "/*\n" + "".join(f" * {line}\n" for line in "\n".join(bsd3).split("\n")) + " */"
    other = [bsd[0], bsd[1], "2. Something else.", wrap(3, "bsd-binary")]
    assert found(spark, "\n".join(bsd), "\n\n".join(bsd3), "\r\n".join(bsd3), comment, "\n".join(other)) == ["BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause", "BSD-3-Clause", ""]


def scan(text, sentences, rules):
    """What a text states, step by step over its sentences and its lines."""
    plain = lambda p: re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), p))
    form = lambda p: re.sub("^ ?[0-9] ", " ", plain(re.sub(r"^[^A-Za-z0-9(]*\(?([0-9]{1,2}|[A-Za-z])\)", " ", p))).strip()
    holes = [(i, *(plain(x).strip() for x in t.split("{}"))) for i, t in licenses.HOLES]

    def name(f):
        if f in known or re.fullmatch("[0-9]{1,2}|[a-h]", f):
            return known.get(f, "#")
        fits = (i for i, a, b in holes if f.startswith(a + " ") and f.endswith(" " + b if b else "") and len(f) > len(a) + len(b) + (2 if b else 1))
        return next(fits, "-")

    text = re.sub(r"\b(Inc|Ltd|Corp|Co)\.", r"\1", text or "")
    known = {form(s): k for k, s in sentences.items()}
    counts, names, n = [], set(), None
    for end in (r"[.!?:;]+(?:[\t\n\f\r ]|\Z)|\n[\t\r ]*\n", r"[\r\n]+"):
        forms = [f for f in map(form, re.split(end, text)) if f]
        n = len(forms) if n is None else n
        ids = [i for i in map(name, forms) if i != "#"]
        counts.append(sum(i != "-" for i in ids))
        for licence, run in rules:
            at = 0
            while at + len(run) <= len(ids):
                if ids[at : at + len(run)] == run:
                    ids[at : at + len(run)] = [("done", licence)]
                    names.add(licence)
                at += 1
    for tag in re.findall(r"SPDX-License-Identifier:[ 	]*([A-Za-z0-9(][A-Za-z0-9.+() -]*)", text):
        names.update(i for i in re.sub(r" WITH [^ ]+", "", re.sub(r"[()]", " ", tag)).split() if i.upper() not in ("AND", "OR"))
    return n, max(counts), len(names), ",".join(sorted(names))


def test_sentences_with_holes(spark):
    """Texts as they are in the wild: organisations by name, lettered clauses, other words for the third clause, tags."""
    s = licenses.SENTENCES
    head, tail = [s["bsd-allow"], s["bsd-source"], s["bsd-binary"]], " ".join(s[k] for k in ("bsd-as-is", "bsd-liable", "bsd-loss", "bsd-theory"))
    third = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    names = ["Google Inc.", "the University of California, Berkeley", "the <organization>", "Foo Co. Ltd.", "Yahoo! Inc."]
    marks = [("1.", "2.", "3."), ("a.", "b.", "c."), ("(a)", "(b)", "(c)"), ("*", "*", "*"), ("  1)", "  2)", "  3)"), ("-", "-", "-")]
    bsd3 = [f"{head[0]}\n\n{m[0]} {head[1]}\n{m[1]} {head[2]}\n{m[2]} {third.format(n)}\n\n" for n in names[:4] for m in marks]
    named = tail.replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS").replace("THE COPYRIGHT HOLDER OR CONTRIBUTORS", "GOOGLE INC. OR ITS EMPLOYEES")
    texts = [*bsd3, *(t + named for t in bsd3[:3]), *(textwrap.fill(t, 75) for t in bsd3[:2])]
    assert set(found(spark, *texts)) == {"BSD-3-Clause"}
    author = f"{head[0]} 1. {head[1]} 2. {head[2]} 3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission. "
    odd = f"{head[0]} 1. {head[1]} 2. {head[2]} 3. Neither the name of Foo nor those of Bar may be used in any way. "
    two = f"{head[0]} 1. {head[1]} 2. {head[2]} " + named
    isc = s["isc-grant-2"] + " " + s["isc-as-is"].replace("THE AUTHOR", "INTERNET SYSTEMS CONSORTIUM") + " " + s["isc-liable"].replace("THE AUTHOR", "ISC")
    mit = " ".join([s["mit-grant"], s["mit-keep"], s["mit-as-is"], s["mit-liable"].replace("THE AUTHORS OR COPYRIGHT HOLDERS", "X CONSORTIUM")])
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."
    assert found(spark, author, odd, two, isc, mit, gpl) == ["BSD-3-Clause", "LicenseRef-BSD-variant", "BSD-2-Clause", "ISC", "MIT", "GPL-2.0-only"]
    tags = ["// SPDX-License-Identifier: MIT\nint x;", "# SPDX-License-Identifier: (Apache-2.0 OR MIT) AND GPL-2.0-or-later WITH Classpath-exception-2.0", "/* SPDX-License-Identifier: GPL-2.0+ */", "SPDX-License-Identifier:", "no tag MIT"]
    assert found(spark, *tags) == ["MIT", "Apache-2.0,GPL-2.0-or-later,MIT", "GPL-2.0+", "", ""]
    con = duckdb.connect()
    frame = spark.createDataFrame(list(enumerate([*texts, author, odd, two, isc, mit, gpl, *tags])), "doc_id long, text string")
    con.register("documents", frame.toPandas())
    want = {r.doc_id: (r.n_sentences, r.n_known, r.n_licenses, r.licenses) for r in licenses.license_scan(frame).collect()}
    assert {r[0]: r[1:] for r in con.sql(licenses.license_sql()).fetchall()} == want


def test_against_brute_force_and_sql(spark, odd_rows):
    dice = random.Random(6)
    known = list(licenses.SENTENCES.values())
    runs = [[licenses.SENTENCES.get(i, "Neither the name of Foo nor that of Bar may be used.") for i in run] for _, run in licenses.RULES]
    texts = []
    for _ in range(300):
        parts = []
        for _ in range(dice.randint(0, 4)):
            run = list(dice.choice(runs)) if dice.random() < 0.7 else [dice.choice(known), "Other words here."]
            if dice.random() < 0.3:
                run.pop(dice.randrange(len(run)))
            if dice.random() < 0.3:
                run = [f"{i + 1}. {s}" for i, s in enumerate(run)]
            parts.append(dice.choice([" ", "\n", "\n\n", " \r\n"]).join(run))
        texts.append(textwrap.fill(" ".join(parts), 70) if dice.random() < 0.3 else "\n".join(parts))
    names = iter(["Acme Inc.", "X & Y Corp.", "The Z Project", "Q"] * 200)
    texts = [re.sub("the copyright holder ", lambda m: next(names) + " ", t) if dice.random() < 0.5 else t for t in texts]
    texts += [r[1] for r in odd_rows] + ["a. b. c. (d) e", "SPDX-License-Identifier: MIT or (Zlib)\nSPDX-License-Identifier: 0BSD"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: scan(t, licenses.SENTENCES, licenses.RULES) for i, t in enumerate(texts)}
    got = {r.doc_id: (r.n_sentences, r.n_known, r.n_licenses, r.licenses) for r in licenses.license_scan(frame).collect()}
    assert got == want and len({w[3] for w in want.values()}) > 25
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    assert {r[0]: r[1:] for r in con.sql(licenses.license_sql()).fetchall()} == want


def test_a_table_made_of_whole_texts(spark):
    s = licenses.SENTENCES
    texts = {"X-1": " ".join(s[k] for k in ("bsd-allow", "bsd-source", "bsd-binary")), "X-2": "First of its own kind. 1. Second rule;\n\n2. third: " + s["mit-keep"]}
    sentences, rules = licenses.rules_from_texts(texts)
    rows = licenses.license_scan(spark.createDataFrame([(1, "Intro. " + texts["X-2"]), (2, texts["X-1"].upper()), (3, texts["X-2"].replace("third", "fourth"))], "doc_id long, text string"), sentences, rules).collect()
    assert {r.doc_id: r.licenses for r in rows} == {1: "X-2", 2: "X-1", 3: ""}


FOLDER = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.exists(f"{FOLDER}/Apache-2.0"), reason="no licence texts on this machine")
def test_whole_licences_of_a_folder(spark):
    names = [n for n in os.listdir(FOLDER) if not os.path.islink(f"{FOLDER}/{n}")]
    texts = {n: open(f"{FOLDER}/{n}", encoding="utf-8", errors="replace").read() for n in names}
    sentences, rules = licenses.rules_from_texts(texts)
    assert len(sentences) > 500
    docs = [(i, "Copyright (c) 2020 Someone.\n\n" + textwrap.indent(texts[n], " * ") + "\n\nint main(void);\n") for i, n in enumerate(names)] + [(len(names), texts[names[0]].replace(" the ", " a ", 1))]
    rows = licenses.license_scan(spark.createDataFrame(docs, "doc_id long, text string"), sentences, rules).collect()
    found_in = {r.doc_id: r.licenses.split(",") for r in rows}
    assert all(n in found_in[i] for i, n in enumerate(names))
    assert names[0] not in found_in[len(names)]
