"""Quality rules, line dedup, sharding and licence scans: brute force and odd rows."""

import collections
import math
import re
import zlib

import pytest
from conftest import SF_CHECK, SF_SMALL
from pyspark.sql import functions as F
from sparkprep.llm import decontaminate, licenses, line_dedup, near_dedup, quality, queries, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, shard string, score string, n_words string, h1 string"
LONG = "word one two three. " * 30_000
ODD = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "   \n\t\n ", None, "b", 5), (4, "one", "en", None, 3), (4, "one", "en", None, 3),
    (None, "no id here", "en", "c", 10), (6, LONG, "en", "a", len(LONG)), (7, "a b c a b c a b c", "en", "a", 17), (7, "same id, other text", "de", "b", 19),
    (8, "éß中\U0001F600  x\n" * 3, "fr", "c", 18), (9, "Licensed under the MIT License.\nx", "en", "d", 33),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "k", "s", "x", "w", "h") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def base(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_base_measures_by_brute_force(spark, odd):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = quality.with_measures(docs).select("text", "__m.*").collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(r.text)


def test_quality_query_verdicts(spark):
    out = {r.doc_id: r for r in queries.op1(spark, SF_CHECK).collect()}
    for r in out.values():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()
    judged = [(x.quality == 1, out[x.doc_id].kept) for x in labels if not out[x.doc_id].base_failed]
    assert sum(a == b for a, b in judged) >= 0.98 * len(judged)


def em_by_rows(votes, n_rules):
    """The same model fitted row by row."""
    good = [0.05 if min(v) < 0 else 0.95 for v in votes]
    for _ in range(quality.MAX_ITERATIONS):
        prior = (sum(good) + quality.PRIOR_GOOD) / (len(votes) + 1)
        rate = [[[(quality.SMOOTH + sum(w for v, w in zip(votes, ws, strict=True) if v[j] == x)) / (3 * quality.SMOOTH + sum(ws)) for x in (-1, 0, 1)]
                 for ws in ([1 - g for g in good], good)] for j in range(n_rules)]
        good = []
        for v in votes:
            a = prior * math.prod(rate[j][1][v[j] + 1] for j in range(n_rules))
            b = (1 - prior) * math.prod(rate[j][0][v[j] + 1] for j in range(n_rules))
            good.append(a / (a + b))
    return good


def test_posteriors_equal_rowwise_expectation_maximisation(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    judged, model = quality.judged(docs, keep=["doc_id"])
    rows = sorted(judged.select("__votes", "__posterior").collect(), key=lambda r: r[0])
    expected = em_by_rows([tuple(r[0]) for r in rows], len(quality.RULES))
    assert max(abs(r[1] - e) for r, e in zip(rows, expected, strict=True)) < 1e-4
    assert all(0 < model.accuracy(j) <= 1 for j in range(len(quality.RULES)))


def test_quality_odd_rows(spark, odd, empty):
    judged, _ = quality.judged(odd)
    assert judged.count() == len(ODD)
    assert all(r["__base_failed"] for r in judged.filter("text IS NULL OR doc_id IN (2, 3)").collect())
    assert quality.judged(empty)[0].count() == 0
    assert quality.fit([]).prior == quality.PRIOR_GOOD


def boilerplate_by_hand(docs, least):
    """Lines on enough sites, texts that mostly consist of such lines aside."""
    shown = collections.defaultdict(dict)
    for _, site, text in docs:
        for x in (text or "").split("\n"):
            n = x.strip(" \t\n\x0b\x0c\r").lower()
            if len(n.split()) >= line_dedup.MIN_WORDS:
                shown[n][text] = min(site, shown[n].get(text, site))
    shared = {n for n, sites in shown.items() if len(set(sites.values())) >= least}
    words = collections.defaultdict(lambda: [0, 0])
    for n, sites in shown.items():
        for text in sites:
            words[text][0] += len(n.split()) * (n in shared)
            words[text][1] += len(n.split())
    return {n for n in shared if len({s for t, s in shown[n].items() if 2 * words[t][0] <= words[t][1]}) >= least}


def test_near_copies_make_no_boilerplate(spark):
    """Twenty near copies of an article on as many sites keep their lines; a notice that they carry, shown by others too, goes."""
    article = [f"line {j} of an article that many sites print alike" for j in range(10)]
    rows = []
    for i in range(20):
        lines = list(article)
        lines[i % 10] = f"line changed by the editor of site {i} in his own words"
        rows.append((i, "\n".join([*lines, "a notice of every site"]), f"s{i}"))
    rows += [(100 + i, f"some own words {i} of a page and more of them\na notice of every site\nthe end of page {i} after all of this", f"s{i}") for i in range(4)]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[i] == text.replace("\na notice of every site", "") for i, text, _ in rows)


def test_line_dedup_by_brute_force(spark):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()]
    for least in (3, line_dedup.MIN_SITES):
        gone = boilerplate_by_hand(docs, least)
        out = line_dedup.dedup_lines(spark.read.parquet(f"{SF_CHECK}/documents.parquet"), min_sites=least)
        got = {r.doc_id: r for r in out.collect()}
        assert len(got) == len(docs) and gone
        for i, _, text in docs:
            left = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r").lower() not in gone]
            assert got[i].text == "\n".join(left)
            assert got[i]["__n_removed"] == len(text.split("\n")) - len(left)


def test_line_dedup_near_and_clear_lines(spark):
    rows = [(i, f"wide line shown all over\nnear line shown here\nown words {i} only {s} " + " ".join(f"x{i}y{j}" for j in range(12)), f"s{s}") for i, s in enumerate(range(40))]
    rows += [(100 + i, "near line not quite enough\nrest of it " + " ".join(f"z{i}y{j}" for j in range(12)), f"s{i}") for i in range(8)]
    rows += [(200 + i, "whole copy on many sites\nits second line too", f"s{i}") for i in range(30)]
    found = line_dedup.boilerplate_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=9).collect()
    assert len(found) == 2  # copies of one text count once; eight sites are too few
    assert all(r.sites is None for r in found)  # both are clear of the threshold
    exact = line_dedup.boilerplate_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=8).collect()
    assert sorted(r.sites or 0 for r in exact) == [0, 0, 8]


def test_passages_on_few_sites(spark):
    """Passages of over 50 words and short notices planted on 2 to 8 sites: from three on they go, wherever they
    stand, and nothing else does; clean documents beside them, one on many sites, keep every line."""
    passage = lambda n: " ".join(f"p{n}w{j}" for j in range(60))
    rows, expect = [], {}
    for n in range(2, 9):
        for site in range(n):
            i = 100 * n + site
            own = " ".join(f"d{i}v{j}" for j in range(70))
            lines = [own, passage(n), f"another own line {i}", f"short notice number {n}"]
            rows.append((i, "\n".join(lines), f"s{site}"))
            expect[i] = "\n".join(lines if n < 3 else lines[::2])
    for i in range(30):
        rows.append((i, f"clean text {i} with its words\nand a second line {i} of it\nyes", f"s{i % 9}"))
        expect[i] = rows[-1][1]
    rows += [(5000 + i, "a whole document\nthat stands on many sites", f"s{i}") for i in range(9)]
    expect |= {5000 + i: rows[-1][1] for i in range(9)}
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: r.text for r in out} == expect


def test_stages_take_any_column_name(spark):
    """Names of the operators' own columns, dots and marks: kept as they are, or replaced by a result of that name."""
    names = ["__m", "__w", "__l", "__h", "__id", "__th", "__gone", "__row", "__hash", "__first", "__c", "c0", "a.b", "x`y", "text_hash", "node"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names}).withColumn("__kept", F.lit("old"))
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").withColumn("__h", F.lit(1))
    plain = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    pairs = [(quality.judged(docs)[0].filter("__kept"), quality.judged(plain)[0].filter("__kept")), (line_dedup.dedup_lines(docs), line_dedup.dedup_lines(plain)),
             (near_dedup.one_of_each(docs), near_dedup.one_of_each(plain)), (decontaminate.decontaminated(docs, bench), decontaminate.decontaminated(plain, bench))]
    for k, (wide, narrow) in enumerate(pairs):
        rows = wide.collect()
        assert set(docs.columns) <= set(wide.columns) and len(set(wide.columns)) == len(wide.columns)
        own = [n for n in names if n not in quality.RESULTS or k]
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in own) and (k == 0 or {r["__kept"] for r in rows} == {"old"})
        assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in narrow.collect())


def test_line_dedup_odd_rows(odd, empty):
    out = line_dedup.dedup_lines(odd, min_sites=1)
    assert out.count() == len(ODD) and set(odd.columns) <= set(out.columns)
    assert out.filter("text IS NULL").count() == 1
    assert line_dedup.dedup_lines(empty).count() == 0
    again = line_dedup.dedup_lines(odd).select("doc_id", "text").collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter((r[0], r[1]) for r in ODD)


def test_shards_follow_their_law(spark):
    out = queries.op6(spark, SF_CHECK).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in out) == sorted(docs)
    shards = collections.defaultdict(list)
    for r in out:
        text = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32) == (len(text) + 1, zlib.crc32(text))
        shards[r.shard].append(r)
    counts = [len(shards[k]) for k in range(16)]
    assert max(counts) - min(counts) <= 1
    mixture = collections.Counter(d.source for d in docs.values())
    for rows in shards.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        here = collections.Counter(r.source for r in rows)
        assert all(abs(here[s] - n / 16) <= 1.01 for s, n in mixture.items())


@pytest.mark.parametrize("bucket", [1, 7, 10_000])
def test_shards_by_brute_force(spark, odd, bucket):
    import hashlib
    rows = [(r[0], r[1], r[3]) for r in ODD] + [(i, f"t{i}", "hot") for i in range(20, 120)]
    got = sharding.interleaved_shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), 5, rows_per_bucket=bucket).collect()
    strata = collections.defaultdict(list)
    for i, t, s in rows:
        raw = (t or "").encode()
        h = hashlib.md5(f"mix-1:{'' if i is None else i}".encode()).hexdigest()
        strata["n" if s is None else "s" + s].append((h, -1 if i is None else i, zlib.crc32(raw), len(raw) + 1))
    order = []
    for s, members in strata.items():
        for r, m in enumerate(sorted(members), 1):
            order.append(((2 * r - 1) / (2 * len(members)), s, m))
    order.sort()
    n = len(order)
    expected = [(m[1], m[2], p * 5 // n, p - (p * 5 // n * n + 4) // 5) for p, (_, _, m) in enumerate(order)]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text_crc32, r.shard, r.slot) for r in got) == sorted(expected)


def test_shards_of_many_small_sources(spark, monkeypatch):
    """Every source has one row or three: half of all rows and more have one fractional rank."""
    rows = [(i, f"t{i}", f"s{i * 7919 % 2000:05d}") for i in range(2000)] + [(5000 + i, "t", f"three{i // 3}") for i in range(300)]
    sizes, cells = [], sharding._cells

    def watched(*a):
        out = cells(*a)
        sizes.append(out.groupBy("__g", "__cf", "__cs").count().agg(F.max("count")).first()[0])
        return out
    monkeypatch.setattr(sharding, "_cells", watched)
    got = sharding.interleaved_shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), 4, rows_per_bucket=50).collect()
    assert sizes[0] < 700  # 2,100 rows of the same fractional rank
    assert sorted(r.position for r in got) == list(range(2300))
    n = collections.Counter(r[2] for r in rows)
    order = [((2 * r.stratum_rank - 1) / (2 * n[r.stratum]), "s" + r.stratum) for r in sorted(got, key=lambda r: r.position)]
    assert order == sorted(order) and len(set(order)) == 2300


def test_shards_of_nothing(empty):
    assert sharding.interleaved_shards(empty).count() == 0


@pytest.mark.parametrize("text, names", [
    ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("Released under the MIT License.", ["MIT"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC"]),
    ("SPDX-License-Identifier: BSD-3-Clause", ["BSD-3-Clause"]),
    ("SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0"]),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"). "
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
     "The Software is provided \"as is\", without warranty of any kind, express or implied.", ["MIT"]),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted.\n"
     "Redistributions of source code must retain the above copyright notice.\n"
     "Redistributions in binary form must reproduce the above copyright notice.\n"
     "This software is provided by the copyright holders and contributors as is.", ["BSD-2-Clause"]),
    ("Redistributions of source code must retain the above copyright notice.", []),  # a part of a rule is none
    ("Nothing about terms here.", []), ("", []), (None, []),
    ("The licence fee went up.", []),
    ("Licensed under the MIT License.\nReleased under the MIT licence.\nLicensed under CC BY 4.0.", ["MIT", "CC-BY"]),
])
def test_licences(spark, text, names):
    r = licenses.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.licenses == names


MIT_TEXT = """The MIT License

Copyright (c) 2020 Some Body
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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD_TEXT = """Copyright (c) 2020, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
%s Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
%s Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation.
%s Neither the name of the University nor the names of its contributors may
   be used to endorse or promote products derived from this software.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
APACHE_TEXT = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL_TEXT = """This program is free software%s you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
BSD_IDS = ["copyright", "copyright", "bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is"]
APACHE_IDS = ["apache-grant", "apache-comply", "apache-copy", "apache-as-is", "apache-see"]
GPL_IDS = ["gnu:GPL-3.0", "gpl-hope", "gpl-see", "gpl-copy"]


@pytest.mark.parametrize("mark", ["", " * ", "// ", "# ", ";; ", "dnl "])
def test_wrapped_licence_texts(spark, mark):
    """Texts as they are distributed, plain and as comments; every sentence once."""
    cases = [(MIT_TEXT, "MIT", ["copyright", "mit-grant", "mit-notice", "mit-as-is"]), (APACHE_TEXT, "Apache-2.0", APACHE_IDS),
             *((BSD_TEXT % items, "BSD-3-Clause", BSD_IDS) for items in (("1.", "2.", "3."), ("*", "*", "*"), ("(a)", "(b)", "(c)"))),
             (GPL_TEXT % ":", "GPL-3.0", GPL_IDS), (GPL_TEXT % ";", "GPL-3.0", ["gpl-free", *GPL_IDS]),
             ("This work is licensed under the GNU\nGeneral Public License,\nversion 3", "GPL-3.0", ["ref:GPL-3.0"]),
             ("Copyright (c) 2020 Some Body\nThe code may be used as it is licensed under\nthe MIT license", "MIT", ["copyright", "ref:MIT"])]
    rows = [(i, ("\r\n" if i % 2 else "\n").join((mark + x).rstrip() for x in c[0].split("\n"))) for i, c in enumerate(cases)]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (_, name, ids) in enumerate(cases):
        assert got[i].licenses == [name], (i, got[i])
        assert [x for x in got[i].sentence_ids if x != "unknown"] == ids


def test_lines_without_ends_are_not_one_sentence(spark):
    text = "Code is licensed under the MIT License\nDocs are licensed under the GNU General\nPublic License, version 3\nThe licence fee went up"
    cut = "Permission is hereby granted, free of charge, to any person obtaining a copy\n\nof this software and associated documentation files"
    out = licenses.scanned(spark.createDataFrame([(1, text), (2, cut), (3, "a line of words\n" * 3000 + "Released under\nthe MIT License")], "doc_id long, text string"))
    got = {r.doc_id: (r.licenses, r.sentence_ids) for r in out.collect()}
    assert got == {1: (["GPL-3.0", "MIT"], ["ref:MIT", "ref:GPL-3.0", "unknown"]), 2: ([], ["unknown"]), 3: (["MIT"], ["ref:MIT"])}


def test_licence_sql_and_odd_rows(spark, duck, odd, empty):
    got = collections.Counter(map(tuple, queries.op3(spark, SF_SMALL).collect()))
    want = duck.execute(f"SELECT doc_id, licenses, sentence_ids, n_unknown FROM ({queries.SQL['op3_license_scan']})").fetchall()
    assert got == collections.Counter(want)
    out = licenses.scanned(odd)
    assert out.count() == len(ODD) and out.filter(F.size("licenses") > 0).count() == 1
    assert licenses.scanned(empty).count() == 0


def test_line_sql(spark, duck):
    got = collections.Counter(map(tuple, queries.op5(spark, SF_SMALL).collect()))
    want = duck.execute(f"SELECT doc_id, n_lines, n_removed, text FROM ({queries.SQL['op5_line_dedup']})").fetchall()
    assert got == collections.Counter(want)


GNU_NOTICE = """This %s is free software%s you can redistribute it and/or
modify it under the terms of the GNU %sGeneral Public
License as published by the Free Software Foundation; either
version %s of the License, or (at your option) any later version."""


@pytest.mark.parametrize("text, names", [
    (GNU_NOTICE % ("library", ";", "Lesser ", "2.1"), ["LGPL-2.1"]), (GNU_NOTICE % ("program", ":", "Affero ", "3"), ["AGPL-3.0"]),
    (GNU_NOTICE % ("program", ";", "", "2"), ["GPL-2.0"]), (GNU_NOTICE % ("library", ";", "Library ", "2"), ["LGPL-2.0"]),
    ("This code is not licensed under the MIT license.", []), ("It is no longer released under the GPL version 2.", []),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", ["Apache-2.0", "MIT"]), ("SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0)", ["GPL-2.0"]),
    ("# SPDX-License-Identifier: BSD-3-Clause AND (MIT OR ISC)", ["BSD-3-Clause", "MIT", "ISC"]),
    ("This crate is dual-licensed under the MIT license and the Apache License, Version 2.0.", ["Apache-2.0", "MIT"]),
    ("Licensed under either the MIT license or the Apache License 2.0.", ["Apache-2.0", "MIT"]),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one.", ["MPL-2.0"]),
    ("Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely.", ["zlib"]),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\nEveryone is permitted to copy", ["GPL-3.0"]),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n", ["Apache-2.0"]),
])
def test_families_expressions_and_titles(spark, text, names):
    row = licenses.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert sorted(row.licenses) == sorted(names), row


def test_sentences_of_any_length(spark):
    """A wrapped sentence is known as the same sentence on one line is."""
    more = [f"and some further words of this grant number {i}" for i in range(60)]
    cases = ["Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"),\n" + "\n".join(more) + ".",
             "\n".join([*more, "and all that is licensed under the", "MIT license."]),
             "Neither the name of\n" + "\n".join(more) + "\nmay be used to endorse or promote products under this license.",
             "\n".join([*more, "Redistributions of source code must", "retain the above copyright notice."])]
    rows = [(2 * i, c) for i, c in enumerate(cases)] + [(2 * i + 1, c.replace("\n", " ")) for i, c in enumerate(cases)]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(len(cases)):
        assert got[2 * i].sentence_ids == got[2 * i + 1].sentence_ids and got[2 * i].n_unknown == 0 and len(got[2 * i].sentence_ids) == 1
    long = "\n".join(f"words {i} without an end, and a warranty" for i in range(20_000))
    assert licenses.scanned(spark.createDataFrame([(1, long)], "doc_id long, text string")).first().n_unknown == 1
