"""Document operators against brute force, on small rows with every odd case."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lobbyforge.llm import byte_bpe, components, licenses, mixing, near_dedup, ppm, quality, registry, sharding, simple8b, toxicity, winnowing
from lobbyforge.llm.common import written

RANKS, TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _tokens int"
WORDS = "the of and thing reading nation over there shed blend ern ou ha tion it is".split()
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows():
    """Nulls, empty and long texts, ties, repeated rows, clashing column names."""
    r = random.Random(5)
    base = [" ".join(r.choice(WORDS) for _ in range(r.randrange(12, 60))) for _ in range(30)]
    texts = [*base, *base[:5], *(t + " extra" for t in base[:6]), None, "", " ", "\n\t ", "one", "One", "é" * 40, "ab " * 4000, "It's  a\n\ntest's 12 ' x", "I'll’ve\u00a0d"]
    out = [(i, t, (None, "en", "de")[i % 3], (None, "src1", "src2", "src2")[i % 4], len(t or ""), "x", 1) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, "a null id here", "en", "src1", 3, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return (row[0] is not None, row[0] or 0)


def text_of(row):
    return row[1] or ""


# ---------------------------------------------------------------- 1


def test_flow_is_least_cost():
    r = random.Random(1)
    for _ in range(30):
        supply = [r.randrange(6) for _ in range(3)]
        capacity = sharding.even_capacities(sum(supply), 3)
        flow = sharding.min_cost_flow(supply, capacity, lambda i, j: int(i != j))
        assert [sum(flow.get((i, j), 0) for j in range(3)) for i in range(3)] == supply
        assert all(sum(flow.get((i, j), 0) for i in range(3)) <= capacity[j] for j in range(3))
        assert sum(a for (i, j), a in flow.items() if i != j) == sum(max(0, s - c) for s, c in zip(supply, capacity))


def test_reshard(docs, empty, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "PART_BYTES", 6000)
    old = F.when(F.col("source") == "src1", 7).otherwise(F.pmod(F.xxhash64("source"), F.lit(3)))
    old = F.when(F.col("source").isNotNull(), old)  # null sources have no shard
    want = Counter((d[0], len(text_of(d).encode()) + 8, zlib.crc32(text_of(d).encode())) for d in rows())
    folder = f"file://{tmp_path}/shards"
    whole = sharding.rewrite(docs, old, 4, folder)
    for got in (sharding.reshard(docs, old, 4).collect(), sharding.digest(whole).collect()):
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r)
        assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
        assert all(r.moved == (r.old_shard != r.shard) for r in got) and {-1, 7} <= {r.old_shard for r in got}
    docs_back = Counter(tuple(r.doc) for r in whole.collect())
    assert docs_back == Counter(tuple(r) for r in docs.collect())
    files = spark.read.parquet(folder)
    touched = {s for r in got if r.moved for s in (r.shard, r.old_shard)}
    assert {r.shard for r in files.select("shard").distinct().collect()} == touched & {r.shard for r in got}
    assert sharding.reshard(empty, old, 4).count() == 0 and sharding.digest(sharding.rewrite(empty, old, 4, folder + "-none")).count() == 0


def test_shards_that_keep_their_rows_are_left(docs, spark, tmp_path):
    """Two of three shards trade rows; the third has just its share and is not written."""
    data = [(i, "x" * 92, "en", "s", i % 4 if i % 4 < 2 else 0, "", 0) for i in range(800)] + [(1000 + i, "y" * 92, "en", "s", 2, "", 0) for i in range(400)]
    table = spark.createDataFrame(data, SCHEMA)
    folder = f"file://{tmp_path}/shards"
    got = sharding.digest(sharding.rewrite(table, F.col("n_chars"), 3, folder)).collect()
    assert {r.shard for r in spark.read.parquet(folder).select("shard").distinct().collect()} == {0, 1}
    assert len(got) == 1200 and all(r.shard == 2 and not r.moved for r in got if r.doc_id >= 1000)
    assert sorted(r.slot for r in got if r.shard == 2) == list(range(400))


def test_law_and_moved_bytes(spark):
    """Sizes are as near equal as blocks allow, and no plan moves fewer bytes but by a block's size."""
    r = random.Random(19)
    data = [(i, "z" * r.randrange(0, 300), "en", "s", r.choice([0, 0, 0, 1, 2, 5]), "", 0) for i in range(6000)]
    table = spark.createDataFrame(data, SCHEMA)
    got = sharding.reshard(table, F.col("n_chars"), 4).collect()
    sizes, old = Counter(), Counter()
    for x in got:
        sizes[x.shard] += x.size
        old[x.old_shard] += x.size
    mean = sum(sizes.values()) / 4
    largest = max(x.size for x in got) * 4  # a block of some rows
    assert all(abs(v - mean) <= largest for v in sizes.values())
    least = sum(max(0, v - mean) if j < 4 else v for j, v in old.items())
    assert abs(sum(x.size for x in got if x.moved) - least) <= 4 * largest


# ---------------------------------------------------------------- 2


def brute_winnow(text, k, w):
    points = [ord(c) for c in text]
    if not points:
        return []
    k, top = min(k, len(points)), (1 << 64) - 1

    def gram(part):
        h = 0
        for p in part:
            x = (p + 1) * winnowing.MIX & top
            h = (h * winnowing.BASE + (x ^ (x >> 29))) & top
        h = h * winnowing.MIX & top
        return (h ^ (h >> 31)) >> 32

    hashes = [gram(points[i : i + k]) for i in range(len(points) - k + 1)]
    w, out = min(w, len(hashes)), []
    for i in range(len(hashes) - w + 1):
        best = min(hashes[i : i + w])
        pair = (best, max(j for j in range(i, i + w) if hashes[j] == best))
        if not out or out[-1] != pair:
            out.append(pair)
    return out


def test_winnow_matches_brute_force():
    r = random.Random(2)
    for _ in range(150):
        text = "".join(r.choice("abé ") for _ in range(r.randrange(60)))
        k, w = r.choice([1, 2, 3, 5, 16]), r.choice([1, 2, 3, 9, 32])
        hashes, places = winnowing.winnow(text, k, w)
        assert list(zip(hashes.tolist(), places.tolist())) == brute_winnow(text, k, w)


def test_winnow_guarantee():
    r = random.Random(3)
    shared = "".join(r.choice("abcdefg ") for _ in range(winnowing.MATCH_LENGTH))
    a, b = ("".join(r.choice("hijklm ") for _ in range(300)) for _ in range(2))
    assert set(winnowing.winnow(a + shared + b)[0]) & set(winnowing.winnow(b[:7] + shared + a)[0])


def test_fingerprints_of_documents(docs, empty):
    got = winnowing.digest(docs).collect()
    order = sorted(rows(), key=lambda d: (d[0] is not None, d[0] or 0, text_of(d)))
    want = []
    for i, d in enumerate(order):
        text, after = text_of(d), text_of(order[i - 1])
        half = len(text) // 2
        want.append((d[0], len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(want)
    alike = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
    coded = lambda pairs: base64.b64encode(b"".join(h.to_bytes(4, "little") for h, _ in pairs)).decode()
    prints = {text_of(d): brute_winnow(text_of(d), winnowing.K, winnowing.WINDOW) for d in order if len(text_of(d)) < 2000}
    whole = {}
    for i, d in enumerate(order):
        text, after = text_of(d), text_of(order[i - 1])
        if text in prints and after in prints:
            own, changed, other = prints[text], brute_winnow(winnowing.edited(text, after), winnowing.K, winnowing.WINDOW), prints[after]
            sets = [{h for h, _ in x} for x in (own, changed, other)]
            whole.setdefault((d[0], len(text), hashlib.sha256(winnowing.edited(text, after).encode()).hexdigest()), set()).add((coded(own), coded(changed), round(alike(sets[0], sets[1]), 9), round(alike(sets[0], sets[2]), 9), tuple(p for _, p in own)))
    checked = [r for r in got if (r.doc_id, r.n_chars, r.edited_sha256) in whole]
    assert len(checked) > 40
    for r in checked:
        assert (r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9), tuple(r.positions)) in whole[r.doc_id, r.n_chars, r.edited_sha256]
    assert winnowing.digest(empty).count() == 0
    assert winnowing.fingerprints(docs).count() == sum(len(winnowing.winnow(text_of(d))[0]) for d in rows())


# ---------------------------------------------------------------- 3


def test_licences(spark, docs):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."
    cases = {mit: "MIT", "words\n * Licensed under the Apache License, Version 2.0.\nmore": "Apache-2.0", "Released under the MIT License. All rights reserved.": "MIT", "All rights reserved.": "All-Rights-Reserved", "a mit license": "", "": "", None: ""}
    df = spark.createDataFrame([(t, 1) for t in cases], "text string, licenses int")
    got = {r.text: "|".join(r.found) for r in licenses.scan(df.select("text")).withColumnRenamed("licenses", "found").collect()}
    assert got == cases
    assert licenses.scan(docs).count() == len(rows())
    known = {i for ids in licenses.KNOWN.values() for i in ids}
    assert all(i in known for _, ids in licenses.RULES for i in ids)
    assert len(licenses.KNOWN) == len(licenses.SENTENCES) + len(licenses.OFFICIAL)


MIT_END = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS BE LIABLE FOR ANY CLAIM.'
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version %d of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
WRAPPED = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\n' + MIT_END,
    "BSD-3-Clause": BSD + "\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.",
    "BSD-2-Clause": BSD,
    "Apache-2.0": '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an "AS IS" BASIS,\n# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "GPL-3.0-or-later": GPL % 3,
    "GPL-2.0-or-later": "".join(f" * {line}\r\n" for line in (GPL % 2).split("\n")),
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY\nAND FITNESS. IN NO EVENT',
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */",
    "Unlicense": "This is free and unencumbered software released into the public\ndomain.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.",
    "All-Rights-Reserved": "Copyright (c) 2020 someone. All rights\nreserved.",
}


def test_wrapped_licences(spark):
    cases = {t: name for name, t in WRAPPED.items()} | {"This work is dedicated to the\n\npublic domain": "", "No rights. Not licensed under the MIT license": ""}
    got = {r.text: r for r in licenses.scan(spark.createDataFrame([(t,) for t in cases], "text string")).collect()}
    assert {t: "|".join(got[t].licenses) for t in cases} == cases
    full = {"MIT": 3, "BSD-3-Clause": 4, "BSD-2-Clause": 3, "Apache-2.0": 3, "GPL-3.0-or-later": 2, "GPL-2.0-or-later": 2, "ISC": 2}
    assert {n: len(got[WRAPPED[n]].license_ids) for n in full} == full


def test_every_licence_entry_is_found(spark):
    entries = {s: (i,) for s, i in licenses.SENTENCES.items()} | licenses.OFFICIAL
    got = {r.text: tuple(r.license_ids) for r in licenses.scan(spark.createDataFrame([(s,) for s in entries], "text string")).collect()}
    assert got == entries
    assert all(re.search(licenses.HINTS, s) for s in entries)


#: How the official texts begin, as published.
TITLES = {
    "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   2. Grant of Copyright License. Subject to the terms and conditions of\n      this License, each Contributor hereby grants to You a perpetual,\n      worldwide, non-exclusive, no-charge, royalty-free, irrevocable\n      copyright license to reproduce, prepare Derivative Works of,\n      publicly display, publicly perform, sublicense, and distribute the\n      Work and such Derivative Works in Source or Object form.\n",
    "GPL-3.0-only": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n",
    "LGPL-2.1-only": "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n Copyright (C) 1991, 1999 Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n",
    "LGPL-2.1-or-later": "// This library is free software; you can redistribute it and/or\n// modify it under the terms of the GNU Lesser General Public\n// License as published by the Free Software Foundation; either\n// version 2.1 of the License, or (at your option) any later version.\n//\n// This library is distributed in the hope that it will be useful,\n// but WITHOUT ANY WARRANTY; without even the implied warranty of\n// MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3 of the\nLicense, or (at your option) any later version.",
    "LGPL-3.0-or-later": "/* SPDX-License-Identifier: LGPL-3.0-or-later */",
}


def rewrapped(text, r):
    """The text at another width, as a comment, with doubled blanks, marks or another case."""
    paragraphs = [" ".join(p.split()) for p in re.split("\n\\s*\n", text)]
    lead = r.choice(["", "# ", " * ", "// ", "\t", "> "])
    out = "\n\n".join(textwrap.fill(p, r.choice([40, 60, 72, 100])) for p in paragraphs)
    out = "\n".join(lead + line for line in out.split("\n"))
    if r.random() < 0.4:
        out = out.replace(" ", "  ", r.randrange(1, 9))
    if r.random() < 0.3:
        out += r.choice(["\n" + "*" * 700, " ****", "\n\n--\nthe end of it"])
    return out.upper() if r.random() < 0.2 else out


def named_bsd(holder, organisation):
    return (
        f"Copyright (c) 2011, {holder}\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
        "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n"
        "   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n"
        f"3. Neither the name of {organisation} nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\n"
        f'THIS SOFTWARE IS PROVIDED BY {organisation.upper()} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED\nWARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.\n'
    )


#: Texts with slots, short references and SPDX expressions, and their licences.
FILLED = {
    named_bsd("Example Inc.", "Example Inc."): "BSD-3-Clause",
    named_bsd("The Regents", "the University of\n   California, Example (and others)"): "BSD-3-Clause",
    named_bsd("J. Doe", "the copyright holder").replace("\n", "\n # "): "BSD-3-Clause",
    "SPDX-License-Identifier: MIT OR Apache-2.0": "MIT|Apache-2.0",
    "// SPDX-License-Identifier: (ISC OR MIT) AND BSD-2-Clause\nint x;": "MIT|BSD-2-Clause|ISC",
    "# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 or MIT": "MIT|GPL-2.0-only",
    "SPDX-License-Identifier: MIT OR " + " OR ".join(["ISC"] * 12) + " OR MPL-2.0": "MIT|ISC|MPL-2.0",
    "This file is licensed under the MIT License, see LICENSE.": "MIT",
    "Licensed under the MIT License (see LICENSE file).": "MIT",
    "code (released under the MIT license; see below)": "MIT",
    "This library\nis licensed under the Apache License, Version 2.0": "Apache-2.0",
    "it is not licensed under the MIT License": "",
    "Neither the name of the game nor the names of its contributors matter": "",
    "licensed under the\n\nMIT License": "",
}


def test_licences_with_slots(spark):
    got = {r.text: "|".join(r.licenses) for r in licenses.scan(spark.createDataFrame([(t,) for t in FILLED], "text string")).collect()}
    assert got == FILLED


def test_licence_titles_and_wrapping(spark):
    r = random.Random(14)
    plain = {**TITLES, **{k: v.replace("\r", "").replace("\n * ", "\n").replace("\n# ", "\n").replace("\n#\n", "\n\n").lstrip("# *") for k, v in WRAPPED.items() if k not in ("MPL-2.0", "All-Rights-Reserved")}}
    cases = [(t, n) for n, t in TITLES.items()] + [(rewrapped(t, r), n) for n, t in plain.items() for _ in range(12) if n not in ("LGPL-3.0-or-later", "GPL-3.0-only", "LGPL-2.1-only")]
    got = {x.text: x.licenses for x in licenses.scan(spark.createDataFrame([(t,) for t, _ in cases], "text string")).collect()}
    assert [(n, got[t]) for t, n in cases if n not in got[t]] == []


def test_used_identifiers_do_not_meet(spark):
    """A used identifier keeps those on its sides apart."""
    rows = spark.createDataFrame([(["Mpl2Ref", "MitRef", "Mpl2Copy"],), (["Gpl3Grant", "MitGrant", "MitNotice", "AsIs", "GplHope"],)], "ids array<string>")
    assert [r[0] for r in rows.select(licenses.match_rules(F.col("ids"))).collect()] == [["MIT", "MPL-2.0"], ["MIT", "GPL-3.0-or-later"]]


def test_licence_sql_on_mutations(spark):
    """The query's SQL gives the same on licences rewrapped, cut, mixed and marked at random."""
    r = random.Random(15)
    entries = [*licenses.SENTENCES, *licenses.OFFICIAL, *TITLES.values(), *WRAPPED.values(), *FILLED, "all other words", "the licensed thing", "", "permission"]

    def broken(text):
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            at = r.randrange(len(text) + 1)
            text = text[:at] + r.choice([" ", "\n", "\n\n", "* ", "\u00a0", "é", ". ", "\t", "\r\n", "#", "\u201d"]) + text[at + r.choice([0, 0, 1]) :]
        return rewrapped(text, r) if r.random() < 0.3 else text

    texts = [r.choice(["\n", ". ", " ", "\n\n", "! "]).join(broken(r.choice(entries)) for _ in range(r.randrange(1, 5))) for _ in range(1500)] + [None, ""]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    con = duckdb.connect()
    con.register("documents", docs)
    want = {row[0]: row[1:] for row in con.execute(registry.LICENSE_SQL).fetchall()}
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", F.array_join("license_ids", "|"), F.array_join("licenses", "|"), F.size("licenses"))
    got = {row[0]: tuple(row[1:]) for row in found.collect()}
    assert [(texts[i], got[i], want[i]) for i in got if got[i] != want[i]] == [] and len(got) == len(want)
    assert sum(bool(v[0]) for v in got.values()) > 500


# ---------------------------------------------------------------- 4


def brute_ppm(train, text, order):
    seen = defaultdict(set)
    full = Counter()
    for t in train:
        symbols = [*t.encode(), ppm.END]
        for p, s in enumerate(symbols):
            for k in range(min(order, p) + 1):
                before = symbols[p - k - 1] if p > k else "begin"
                seen[tuple(symbols[p - k : p]), s].add(before)
                full[tuple(symbols[p - k : p]), s] += k == order
    counts = defaultdict(dict)
    for (ctx, s), before in seen.items():
        counts[ctx][s] = full[ctx, s] if len(ctx) == order else len(before)
    symbols, total = [*text.encode(), ppm.END], 0.0
    for p, s in enumerate(symbols):
        out: set = set()
        for k in range(min(order, p), -1, -1):
            found = counts.get(tuple(symbols[p - k : p]))
            left = {x: c for x, c in (found or {}).items() if x not in out}
            if left:
                n = sum(left.values())
                if s in left:
                    total += math.log10((2 * left[s] - 1) / (2 * n))
                    break
                total += math.log10(len(left) / (2 * n))
            out |= set(found or ())
        else:
            total -= math.log10(ppm.SYMBOLS - len(out))
    return total


def test_ppm_matches_brute_force(docs, empty):
    crc = lambda d: zlib.crc32(("" if d[0] is None else str(d[0])).encode()) % 5
    tokens = {t: [*re.findall(r"[^\x20\x09-\x0d]+", t.translate(FOLD)), None] for t in map(text_of, rows())}
    train = [text_of(d) for d in rows() if crc(d) != 1]
    count = Counter(w for t in train for w in tokens[t])
    n, v = sum(count.values()), len(count)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in ppm.scores(docs).collect())
    want = []
    for d in rows():
        t = text_of(d)
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[t])
        want.append((*key(d), crc(d) == 1, len(tokens[t]), sum(count[w] > 0 for w in tokens[t]), n, base, brute_ppm(train, t, ppm.ORDER)))
    for a, b in zip(got, sorted(want, key=lambda x: (*x[:6], round(x[6], 6), round(x[7], 6)))):
        assert a[:6] == b[:6] and a[6:] == pytest.approx(b[6:], abs=2e-5)
    assert ppm.scores(empty).count() == 0


# ---------------------------------------------------------------- 5 and 9


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def test_bpe_matches_library(reference):
    r = random.Random(1)
    letters = "ab'stmdrevl  \n\t1é²!.?　 中"
    texts = ["", "'s", "''s", " 's", " \n ", "I'll've'd", "a" * 3000, "ab" * 500, "'s" * 50, *("".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(3000))]
    ids = byte_bpe.encode_texts(texts, RANKS)
    assert ids == [reference.encode_ordinary(t) for t in texts]
    assert all(byte_bpe.decode_ids(i, RANKS) == t.encode() for i, t in zip(ids, texts))


def test_bpe_of_documents(docs, empty, reference):
    got = byte_bpe.digest(docs, RANKS).collect()
    want = Counter()
    for d in rows():
        ids = reference.encode_ordinary(text_of(d))
        want[d[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text_of(d).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert byte_bpe.digest(empty, RANKS).count() == 0
    want = Counter()
    for d in rows():
        pieces = [(m.start(), m.end()) for m in regex.finditer(public_tokenizers.PATTERN, text_of(d))]
        want[d[0], tuple(reference.encode_ordinary(text_of(d))), tuple(a for a, _ in pieces)] += 1
    got = byte_bpe.encode_documents(docs, RANKS).collect()
    assert Counter((r.doc_id, tuple(r.ids), tuple(r.offsets)) for r in got) == want
    with pytest.raises(ValueError):
        byte_bpe.encode_documents(docs.withColumn("ids", F.lit(1)), RANKS, keep=("doc_id", "ids"))


def test_closing_signs_are_cut_where_the_library_cuts():
    library = simple8b.coder(TOKENIZER).library
    parts = ["a", "B", "9", "'", ".", ",", "!!", "'s", "n't", "é", "¿", " ", "\n", "(", ")", "$", "_", "ab", "!" * 9]
    rng = random.Random(9)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += ["a" + "!" * k + " b." for k in range(20)] + ["w" + "." * 50_000, ".", ". .", "x.\ny,"]
    assert [x.tolist() for x in simple8b.token_ids(texts, TOKENIZER)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    makers = (lambda n: rng.integers(0, 50000, n), lambda n: rng.integers(0, 2, n), lambda n: np.zeros(n), lambda n: (rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)) >> rng.integers(0, 64, n).astype(np.uint64))
    for n, make in itertools.product((0, 1, 255, 256, 257, 5000), makers):
        values = np.asarray(make(n)).astype(np.uint64)
        words, offsets = simple8b.encode(values)
        assert (simple8b.decode(words, offsets, n) == values).all()
        if n > 600:
            assert (simple8b.decode_block(words, offsets, n, 1) == values[256:512]).all()


def test_token_files(docs, empty):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = sorted(simple8b.read_files(simple8b.write_files(docs, TOKENIZER)).collect(), key=lambda r: r.start)
    start, want = 0, []
    for d in sorted(rows(), key=lambda d: (d[0] is not None, d[0] or 0, text_of(d))):
        ids = np.array([*tokenizer.encode(text_of(d), add_special_tokens=False).ids, 0], "<u4")
        want.append((d[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert simple8b.read_files(simple8b.write_files(empty, TOKENIZER)).count() == 0


def test_ids_are_the_library_s():
    """Special tokens in texts, signs behind words, contractions, and tokenizers of another kind."""
    r = random.Random(12)
    parts = ["word", "Word", "l'été", "don't", "x.", "y,", "z!?", "a.b", "(c)", "12.", "3's.", "'s.", "été.", "ñ,", "-", "...", "<|endoftext|>", "<|endoftext|>.", "a_b_", "中。", "é!", "$5", "Ⅷ.", "²!", "e\u0301."]
    texts = ["".join(r.choice(parts) + r.choice([" ", " ", "\n", "  "]) for _ in range(r.randrange(1, 9))).strip(" ") for _ in range(4000)]
    library = Tokenizer.from_file(TOKENIZER)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in simple8b.token_ids(texts, TOKENIZER)] == want
    assert [x.tolist() for x in simple8b.token_ids(texts[::-1], TOKENIZER)] == want[::-1]
    assert any(50256 in w for w in want) and simple8b.coder(TOKENIZER).cuttable
    other = public_tokenizers.path("word_bpe_49k.json")
    assert not simple8b.coder(other).cuttable
    library = Tokenizer.from_file(other)
    assert [x.tolist() for x in simple8b.token_ids(texts[:300], other)] == [library.encode(t, add_special_tokens=False).ids for t in texts[:300]]


# ---------------------------------------------------------------- 6


def test_deobfuscation(spark):
    r = random.Random(4)
    part = ["read", "ing", "th", "er", "on", "ous", "ment", "le", "ra", "sti", "po", "can"]
    word = lambda: "".join(r.choice(part) for _ in range(r.randrange(1, 5)))
    plain = [" ".join(word() for _ in range(30)) for _ in range(400)]
    bad = [" ".join([*p.split()[:10], w, *p.split()[10:], v]) for p, w, v in zip(plain[:80], itertools.cycle(["idiot", "moron", "stupid"]), itertools.cycle(["moron", "scum"]))]
    data = [(i, t) for i, t in enumerate([*plain, *bad])]
    tests = ["you 1d10t of the thing", "what a m o r o n it is", "stuuuupid over there", "a m0r0n and s.c.u.m", "the idi0t!!"]
    clean = ["the 4 things of 12", "call +1 (555) 010-0000 over there", "the e r of a thing", "", None, "th3 nation of 1t"]
    docs = spark.createDataFrame([*data, *((1000 + i, t) for i, t in enumerate([*tests, *clean]))], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, 1, int(i >= 400)) for i, _ in data), (3, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.judge(docs, labels).collect()}
    assert [got[1000 + i].predicted for i in range(len(tests))] == [1] * len(tests)
    assert [got[1000 + len(tests) + i].predicted for i in range(len(clean))] == [0] * len(clean)
    held = [i for i, _ in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == int(i >= 400) for i in held) >= 0.95 * len(held)
    assert all(0 <= x.score <= 1 for x in got.values())


def brute_costs(texts):
    """Trigram costs by counting every text's characters one by one."""
    n = toxicity.SIZE
    three = Counter()
    for t in texts:
        ids = [toxicity.EDGE, toxicity.EDGE, *(int(toxicity.IDS[ord(c)]) for c in t), toxicity.EDGE]
        three.update(zip(ids, ids[1:], ids[2:]))
    for a in range(n):
        three.pop((a, toxicity.EDGE, toxicity.EDGE), None)
    two, one = Counter(), Counter()
    for (_, b, c), k in three.items():
        two[b, c] += k
        one[c] += k
    p1 = [(one[c] + 1) / (one.total() + n) for c in range(n)]
    row2, row3 = Counter(), Counter()
    for (b, c), k in two.items():
        row2[b] += k
    for (a, b, _), k in three.items():
        row3[a, b] += k
    p2 = {(b, c): (two[b, c] + 5 * p1[c]) / (row2[b] + 5) for b in range(n) for c in range(n)}
    return np.array([[[-math.log((three[a, b, c] + 5 * p2[b, c]) / (row3[a, b] + 5)) for c in range(n)] for b in range(n)] for a in range(n)])


def brute_toxicity(docs, labels, settings=toxicity.Settings()):
    """(score, predicted) of each (doc_id, text): learning and scoring restated over plain sets and counters."""
    costs = brute_costs([t or "" for _, t in docs])
    restorer = toxicity.Restorer(costs)
    known = {}
    for i, label in labels:
        if i is not None and label is not None and zlib.crc32(str(i).encode()) % 5:
            known[i] = max(label, known.get(i, 0))
    sample = []
    for i, text in docs:
        if i in known:
            words = restorer.text(toxicity.tokens_of(text or ""))
            sample.append((known[i], toxicity.group_of(words), words))
    groups = {c: len({g for k, g, _ in sample if k == c}) for c in (0, 1)}
    seen = defaultdict(lambda: (set(), set()))  # word -> copies' groups among clean and toxic rows
    rows_of = defaultdict(Counter)
    for label, g, words in sample:
        for w in words:
            seen[w][label].add(g)
            rows_of[w][label] += 1
    able = []
    for w, (clean, toxic) in seen.items():
        weight = math.log((len(toxic) + 0.5) / (groups[1] + 1)) - math.log((len(clean) + 0.5) / (groups[0] + 1))
        least = settings.least_stem_weight if w.endswith("~") else settings.least_weight
        if len(toxic) >= settings.least_documents and len(toxic) >= settings.least_spread * rows_of[w][1] and len(w) >= 3 and weight >= least:
            able.append((-len(toxic), w, weight))
    weights = {w: x for _, w, x in sorted(able)[: settings.max_words]}
    without = {c: len({g for k, g, words in sample if k == c and not words & weights.keys()}) for c in (0, 1)}
    buckets = defaultdict(lambda: (set(), set()))
    for w, (clean, toxic) in seen.items():
        b = zlib.crc32(w.encode()) % settings.buckets
        buckets[b][0].update(clean)
        buckets[b][1].update(toxic)
    prior, none = math.log((groups[1] + 1) / (groups[0] + 9)), math.log((without[1] + 0.5) / (without[0] + 9))
    joiner = toxicity.Joiner(toxicity.Model(costs, weights, prior, none, [0.0], 0.0))
    out = []
    for _, text in docs:
        tokens = toxicity.tokens_of(text or "")
        words = restorer.text(tokens)
        hits = (words & weights.keys()) | joiner.find(tokens)
        for letters in restorer.spelt(text, tokens) if text else ():
            hits |= {w for w in weights if w in letters and len(w) > toxicity.STEM}
        lean = 0.0
        for w in words:
            clean, toxic = (len(x) for x in buckets.get(zlib.crc32(w.encode()) % settings.buckets, ((), ())))
            lean += (math.log((toxic + 0.5) / (groups[1] + 1)) - math.log((clean + 0.5) / (groups[0] + 1))) * (toxic + clean) / (toxic + clean + settings.leaning_prior)
        logit = (prior if hits else none) + sum(weights[w] for w in hits) + settings.most_leaning * math.tanh(lean / max(1, len(words)))
        out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))))
    return out


def test_toxicity_matches_brute_force(spark, data):
    """The whole query on the smallest table, and a table of odd rows: null ids and texts, repeats, absent documents, labels that disagree."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{data}/labels.parquet").collect()]
    got = {r.doc_id: r for r in registry.QUERIES["op6_deobfuscation"](spark, data).collect()}
    want = brute_toxicity(docs, labels)
    assert len(got) == len(docs)
    for (i, _), score in zip(docs, want):
        assert got[i].score == pytest.approx(score, abs=1e-9) and got[i].predicted == int(score >= 0.5)
    r = random.Random(21)
    words = "read thing nation over there shed blend".split()
    text = lambda bad: " ".join([*(r.choice(words) + r.choice(words) for _ in range(12)), *(["slimeball", "sl1meb4ll", "s l i m e b a l l"][r.randrange(3)] for _ in range(bad))])
    odd = [(i, text(i % 3 == 0)) for i in range(120)] + [(None, text(1)), (None, None), (200, None), (201, ""), (202, "  "), (5, text(0)), (5, text(0)), (203, "thing " * 3000 + "slimeball")]
    marks = [(i, int(i % 3 == 0)) for i in range(120)] + [(3, 0), (7, None), (None, 1), (999, 1), (200, 1), (5, 1)]
    table = spark.createDataFrame([(i, t, 1, "i", "c") for i, t in odd], "doc_id long, text string, c0 int, i0 string, score string")
    some = Counter((x.i, x.t, round(x.s, 9), x.p) for x in toxicity.judge(table, spark.createDataFrame(marks, "doc_id long, toxic int"), keep=("doc_id", "text", "c0", "i0")).toDF("i", "t", "c0", "i0", "s", "p", "w").collect())
    assert some == Counter((i, t, round(s, 9), int(s >= 0.5)) for (i, t), s in zip(odd, brute_toxicity(odd, marks)))
    assert toxicity.clean_documents(table, spark.createDataFrame(marks, "doc_id long, toxic int")).columns == table.columns


def all_readings(token):
    """Every spelling of a token and its cost before the model's: the lattice, path by path."""
    paths = [("", 0.0)]
    for m in re.finditer(r"(.)\1*", token, re.S):
        paths = [(text + letters, cost + own) for text, cost in paths for letters, own in toxicity.readings(m[1], len(m[0]))]
    return paths


def test_restore_is_the_cheapest_path():
    r = random.Random(31)
    costs = np.random.default_rng(3).random((toxicity.SIZE,) * 3) * 6
    for _ in range(300):
        token = "".join(r.choice("ab1!@.$0é-ll") for _ in range(r.randrange(1, 8)))
        best = min((own + spelling_cost(text, costs), text) for text, own in all_readings(token))
        got = toxicity.restore(token, costs)
        assert spelling_cost(got, costs) + min(own for text, own in all_readings(token) if text == got) == pytest.approx(best[0])


def spelling_cost(text, costs):
    ids = [toxicity.EDGE, toxicity.EDGE, *(int(toxicity.IDS[ord(c)]) for c in text), toxicity.EDGE]
    return sum(costs[a, b, c] for a, b, c in zip(ids, ids[1:], ids[2:]))


@pytest.fixture(scope="module")
def spelt(spark):
    r = random.Random(4)
    part = ["read", "ing", "th", "er", "on", "ous", "ment", "le", "ra", "sti", "po", "can"]
    plain = [" ".join("".join(r.choice(part) for _ in range(r.randrange(1, 5))) for _ in range(30)) for _ in range(400)]
    bad = [f"{p} {w} {v}" for p, w, v in zip(plain[:80], itertools.cycle(["idiot", "moron", "stupid"]), itertools.cycle(["moron", "scum"]))]
    known = list(enumerate([*plain, *bad]))
    labels = spark.createDataFrame([(i, 1, int(i >= 400)) for i, _ in known], "doc_id long, quality int, toxic int")

    def judged(texts):
        docs = spark.createDataFrame([*known, *((1000 + i, t) for i, t in enumerate(texts))], "doc_id long, text string")
        return {r.text: r.predicted for r in toxicity.judge(docs, labels, keep=("doc_id", "text")).filter("doc_id >= 1000").collect()}

    return judged


def test_long_tokens_are_decoded(spelt):
    toxic = ["over 1d1" + "0" * 50 + "t there", "on_the_er_1d10t_and_the_m0r0n_over_ing_read_le_ra", "read/" * 12 + "m0r0n", "read1ng" * 6 + "m0r0n" + "read1ng" * 6]
    clean = ["see http://example.org/" + "reading/the/" * 8 + "4", "9" * 300, "key " + "a1b2c3" * 20]
    assert spelt([*toxic, *clean]) == {t: 1 for t in toxic} | {t: 0 for t in clean}


def test_words_in_pieces(spelt):
    toxic = ["reading s c u m there", "a mo ron over", "the stu pid thing", "ra id i 0t.", "the on s c u m o n"]
    clean = ["the mo. Ron is over", "s c of u m", "the er on ra"]
    assert spelt([*toxic, *clean]) == {t: 1 for t in toxic} | {t: 0 for t in clean}


def test_toxicity_edges(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = toxicity.clean_documents(docs, none)
    assert kept.columns == docs.columns and kept.count() == len(rows())
    assert toxicity.clean_documents(empty, none).count() == 0


# ---------------------------------------------------------------- 7


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_quality(docs, empty, spark):
    got = quality.judge(docs).collect()
    want = Counter((d[0], *brute_base(text_of(d))) for d in rows())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    assert quality.kept_documents(empty).count() == 0


def test_divergence(spark):
    r = random.Random(6)
    good = [" ".join(r.choice(WORDS) + r.choice(["", "", ".", ","]) for _ in range(80)) for _ in range(200)]
    noisy = [" ".join(w + "%%%" for w in g.split()) for g in good[:5]] + [" | ".join(w for w in g.split()) for g in good[5:10]]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*good, *noisy])], "doc_id long, text string, lang string")
    verdict = {x.doc_id: (x.kept, x.base_failed) for x in quality.judge(docs).collect()}
    assert all(any(verdict[i]) for i in range(200)) and not any(verdict[i][0] for i in range(200, 210))
    assert quality.distance(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1) and quality.distance(np.zeros(2), np.ones(2)) == 0


def brute_distance(p, q):
    """The square root of the Jensen-Shannon divergence, from entropies."""
    if not sum(p) or not sum(q):
        return 0.0
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    entropy = lambda v: -sum(x * math.log2(x) for x in v if x > 0)
    return max(0.0, entropy([(a + b) / 2 for a, b in zip(p, q)]) - (entropy(p) + entropy(q)) / 2) ** 0.5


CLASS_OF = [str.islower, str.isupper, str.isalpha, " \t\u00a0".__contains__, "\n\v\f\r".__contains__, quality.PUNCTUATION_SIGNS.__contains__, quality.SYMBOLS.__contains__]


def brute_classes(text):
    out = [0] * 8
    for c in text:
        if not c.isdigit():
            out[next((i for i, f in enumerate(CLASS_OF) if f(c) and (i > 1 or c.isalpha())), 7)] += 1
    return out


def brute_references(data):
    """By language and for all: upper quartiles of class shares, and common words with the rest."""
    out = {}
    for lang in {d[2] for d in data} | {None}:
        mine = [d[1] for d in data if d[1] and (lang is None or d[2] == lang)]
        levels = []
        for k in range(8):
            steps = sorted(brute_classes(t)[k] * 1000 // max(1, sum(brute_classes(t))) for t in mine)
            levels.append(steps[math.ceil(0.75 * len(steps)) - 1] if steps else 0)
        buckets = Counter()
        for t in mine:
            raw = np.frombuffer(t.encode(), np.uint8)
            buckets.update(quality.word_buckets(raw, *quality.words_of(raw)).tolist())
        common = sorted(b for b, _ in sorted(buckets.items(), key=lambda x: (-x[1], x[0]))[:40])
        if lang is None or sum(buckets.values()) >= 1000:
            out[lang] = (levels, common, [*(buckets[b] for b in common), sum(n for b, n in buckets.items() if b not in common)])
    return out


def brute_verdict(text, lang, refs):
    """(distance of classes, of words, verdict) by the rules as they are written."""
    limits = quality.Limits()
    raw = np.frombuffer(text.encode(), np.uint8)
    buckets = quality.word_buckets(raw, *quality.words_of(raw)).tolist()
    n, chars = len(buckets), len(text)
    by_class = brute_distance(brute_classes(text), refs.get(lang, refs[None])[0])

    def words(ref):
        _, common, usual = ref
        own = [sum(b == c for b in buckets) for c in common]
        own.append(n - sum(own))
        two = lambda v: [sum(v[:-1]), v[-1]]
        few = brute_distance(two(own), two(usual)) if own[-1] * sum(usual) > usual[-1] * n else 0.0
        return brute_distance(own, usual), few, brute_distance([0] * len(common) + [1], usual)

    if lang is None:
        by_word, few, none = min(words(r) for k, r in refs.items() if k is not None or len(refs) == 1)
    else:
        by_word, few, none = words(refs.get(lang, refs[None]))
        none = none if lang in refs else 0.0
    bad = chars >= limits.min_chars and by_class > limits.class_distance + limits.class_allowance / chars**0.5
    bad |= none > 0 and n >= limits.min_common_words and by_word > limits.word_distance * none + limits.word_allowance / n**0.5
    bad |= none > 0 and n >= limits.min_few_words and few > max(limits.few_distance * none, limits.few_allowance / n**0.5)
    return by_class, by_word, not bad


def test_divergence_matches_brute_force(spark):
    """References, distances and verdicts, over odd classes, languages and lengths."""
    r = random.Random(21)
    usual = {"en": WORDS, "de": ["Der", "und", "Ähre", "größe", "in", "den"], None: WORDS, "rare": ["xx", "yy"]}
    odd = ["###", "12", "3.5", "ПРИВЕТ", "中文", "a|b", "%%%", "www@x.y", "ñ", "\u00a0"]

    def made():
        lang = r.choice(["en", "en", "en", "de", "de", None, None])
        share = r.choice([0.0, 0.0, 0.1, 0.6])
        n = r.choice([3, 12, 25, 60, 300])
        return lang, r.choice([" ", "\n", "\t"]).join(r.choice(odd) if r.random() < share else r.choice(usual[lang]) + str(r.randrange(9) if r.random() < 0.05 else "") for _ in range(n))

    data = [(i, t, lang) for i, (lang, t) in enumerate(made() for _ in range(160))] + [(900, "xx yy xx", "rare"), (901, "", "en"), (902, None, "de")]
    refs = brute_references(data)
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    own = quality.references(docs)
    assert set(own) == set(refs) == {"en", "de", None}
    for lang, (levels, common, counts) in refs.items():
        assert own[lang].classes.tolist() == levels and np.flatnonzero(own[lang].place < len(common)).tolist() == common and own[lang].words.tolist() == counts
    got = {x.doc_id: x for x in quality.judge(docs).collect()}
    for i, t, lang in data:
        if t:
            by_class, by_word, good = brute_verdict(t, lang, refs)
            assert (got[i].class_divergence, got[i].word_divergence) == (pytest.approx(by_class, abs=1e-9), pytest.approx(by_word, abs=1e-9))
            assert got[i].kept == (good and not got[i].base_failed)
    assert {x.kept for x in got.values()} == {True, False}


def test_many_languages(spark, monkeypatch):
    """A dirty language column makes no references, and tasks hand on what they hold."""
    monkeypatch.setattr(quality, "HELD", 3)
    text = " ".join(WORDS * 4)
    data = [(i, text, f"l{i}") for i in range(400)] + [(1000 + i, text, "en") for i in range(40)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    assert set(quality.references(docs)) == {None, "en"}
    assert quality.judge(docs).count() == len(data)


def test_words_of_another_language(spark):
    r = random.Random(7)
    usual = {lang: [a + b for a in first for b in "aeiou"] for lang, first in (("en", "bcdfghjk"), ("fr", "lmnprstv"))}
    stem = lambda: "".join(r.choice(["ra", "ti", "no", "le", "ma", "su", "de", "po"]) for _ in range(r.randrange(3, 6)))
    made = lambda n, common: " ".join(r.choice(common) if common and r.random() < 0.3 else stem() for _ in range(n))
    lengths = (30, 60, 150, 600)
    good = [(lang, made(r.choice(lengths), usual[lang])) for lang in usual for _ in range(150)]
    odd = [("en", made(n, usual["fr"])) for n in lengths] + [("fr", made(n, usual["en"])) for n in lengths] + [("en", made(n, None)) for n in lengths]
    free = [(None, made(n, usual[lang])) for lang in usual for n in lengths[1:]] + [("xx", made(100, None))]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate([*good, *odd, *free])], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in quality.judge(docs).collect()}
    assert not any(x.base_failed for x in got.values())
    assert sum(got[i].kept for i in range(len(good))) >= 0.99 * len(good)
    assert [got[len(good) + i].kept for i in range(len(odd))] == [False] * len(odd)
    assert [got[len(good) + len(odd) + i].kept for i in range(len(free))] == [True] * len(free)


# ---------------------------------------------------------------- 8


def test_mixing(docs, empty):
    mix = mixing.Mix(percent=50, max_epochs=2)
    taken = mixing.mix_documents(docs, mix).select("_doc.doc_id", *mixing.LEVELS, "_tokens", "_epoch").collect()
    total = sum(max(1, (len(text_of(d).encode()) + 3) // 4) for d in rows())
    assert 0 < sum(r._tokens for r in taken) <= total // 2
    assert max(r._epoch for r in taken) <= 1
    again = mixing.mix_documents(docs.repartition(5), mix).select("_doc.doc_id", *mixing.LEVELS, "_tokens", "_epoch").collect()
    assert Counter(map(tuple, taken)) == Counter(map(tuple, again))
    assert mixing.mixed_documents(docs, mix).columns == docs.columns
    assert mixing.mixed_documents(empty, mix).count() == 0


def test_mixing_with_many_leaves(docs, monkeypatch):
    """Beyond the bound of a broadcast the same rows are taken."""
    mix = mixing.Mix(percent=50, max_epochs=2)
    columns = ["_doc.doc_id", *mixing.LEVELS, "_tokens", "_epoch", "_order"]
    want = Counter(map(tuple, mixing.mix_documents(docs, mix).select(*columns).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    assert Counter(map(tuple, mixing.mix_documents(docs, mix).select(*columns).collect())) == want


def test_prefixes_of_epochs(spark):
    """Every leaf's taken rows are whole epochs and the longest prefix that its budget allows."""
    r = random.Random(23)
    data = [(i, "x" * r.randrange(1, 400), "en", r.choice(["s0", "s0", "s1", "s6"]), 0) for i in range(700)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars int")
    for percent in (7, 60, 130):
        mix = mixing.Mix(percent=percent)
        taken = mixing.mix_documents(docs, mix).select("_doc.doc_id", "_source", "_tokens", "_epoch", "_order").collect()
        tokens = {i: max(1, (len(t) + 3) // 4) for i, t, *_ in data}
        leaves = spark.createDataFrame([(f"d{ord(s[-1]) % 4}", "en", s, sum(tokens[d[0]] for d in data if d[3] == s)) for s in ("s0", "s1", "s6")], "_domain string, _lang string, _source string, tokens long")
        for leaf in mixing.leaf_budgets(leaves, mix).collect():
            left, want = leaf.budget, Counter()
            for epoch in range(mix.max_epochs):
                ordered = sorted((hashlib.md5(f"17:{epoch}:{d[0]}".encode()).hexdigest(), d[0]) for d in data if d[3] == leaf._source)
                for _, i in ordered:
                    if tokens[i] > left:
                        left = 0
                        break
                    left -= tokens[i]
                    want[i, epoch] += 1
            assert Counter((x.doc_id, x._epoch) for x in taken if x._source == leaf._source) == want


def test_shares_pass_shortages_on(spark):
    nodes = spark.createDataFrame([("a", 5, 1, 100), ("b", 200, 1, 100), ("c", 200, 2, 100)], "_domain string, supply long, weight long, given long")
    got = {r._domain: r.budget for r in mixing.share(nodes, []).collect()}
    assert got == {"a": 5, "b": 31, "c": 63}


# ---------------------------------------------------------------- 10


def brute_groups(data, width, at_least):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(FOLD))
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])

    sets = [shingles(d[1]) for d in data]
    group = list(range(len(data)))
    for i, j in itertools.combinations(range(len(data)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= at_least * len(sets[i] | sets[j]) and group[i] != group[j]:
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    ids = defaultdict(list)
    for g, d in zip(group, data):
        if d[0] is not None:
            ids[g].append(d[0])
    return Counter((d[0], len(s), min(ids[g], default=None) if s else d[0]) for g, d, s in zip(group, data, sets))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, docs, empty, width):
    settings = near_dedup.Settings(width=width)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.groups(docs, settings).collect())
    assert got == brute_groups(rows(), width, 80)
    kept = near_dedup.kept_documents(docs, settings)
    assert kept.columns == docs.columns
    seen = Counter((r.doc_id, r.text) for r in kept.collect())
    assert max(seen.values()) == 1  # repeats of a row are one document
    want = {(i, c) for i, _, c in brute_groups(rows(), width, 80)}
    assert {i for i, _ in seen if i is not None} == {i for i, c in want if i == c and i is not None}
    assert near_dedup.kept_documents(empty, settings).count() == 0


def test_rows_without_ids(spark):
    """Null doc_ids do not meet one another, and a group keeps one row whatever its ids are."""
    r = random.Random(10)
    texts = [" ".join(r.choice(WORDS) for _ in range(40)) for _ in range(60)]
    data = [(None, t) for t in texts] * 3 + [(5, texts[0]), (5, texts[1]), (-7, texts[2]), (None, texts[3] + " more"), (None, None), (None, None), (4, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in near_dedup.groups(docs).collect())
    assert got == brute_groups(data, 2, 80)
    kept = Counter(map(tuple, near_dedup.kept_documents(docs).collect()))
    assert kept == Counter([*((None, t) for t in texts[3:]), (5, texts[0]), (5, texts[1]), (-7, texts[2]), (None, None), (4, "")])


def exact_links(texts, width, at_least):
    """Pairs of equal or similar shingle sets, by the prefixes of rare shingles."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(FOLD))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    common = Counter(x for s in sets for x in s)
    by, links = defaultdict(list), set()
    for i, s in enumerate(sets):
        first = sorted(s, key=lambda x: (common[x], x))[: len(s) - -(-at_least * len(s) // 100) + 1]
        for j in {j for x in first for j in by[x]}:
            if 100 * len(s & sets[j]) >= at_least * len(s | sets[j]):
                links.add((j, i))
        for x in first:
            by[x].append(i)
    return links


@pytest.mark.parametrize("width", [2, 5])
def test_recall_of_links(spark, width):
    """Of all links of the test table at least nine in ten are found (its target; all, as it stands)."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    data = rows.collect()
    links = exact_links([r.text for r in data], width, 80)
    group = {r.doc_id: r.component_id for r in near_dedup.groups(rows, near_dedup.Settings(width=width)).collect()}
    found = sum(group[data[i].doc_id] == group[data[j].doc_id] for i, j in links)
    assert len(links) > 20 and found >= 0.9 * len(links)
    print("recall", found / len(links))


def test_large_groups_and_common_passages(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(100)]
    copies = [" ".join(w if r.random() > 0.03 else word() for w in base) for _ in range(150)]
    passage = [word() for _ in range(30)]
    around = [" ".join([*passage, *(word() for _ in range(r.randrange(3, 20)))]) for _ in range(150)]
    data = [(i, t) for i, t in enumerate([*copies, *around])]
    settings = near_dedup.Settings(small_node=8)
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in near_dedup.groups(spark.createDataFrame(data, "doc_id long, text string"), settings).collect())
    assert got == brute_groups(data, 2, 80)


def test_components_in_parts(spark, monkeypatch):
    r = random.Random(9)
    name = lambda i: f"{i:04d}".encode()
    edges = [(i, i + 1) for i in range(200)] + [(300, i) for i in range(301, 350)] + [(r.randrange(400, 500), r.randrange(400, 500)) for _ in range(60)]
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        above[y] = x
    want = {name(x): name(root(x)) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame([(bytearray(name(a)), bytearray(name(b))) for a, b in edges], "a binary, b binary")
    for size in (500_000, 40):
        monkeypatch.setattr(components, "PART_EDGES", size)
        got = {bytes(x.node): bytes(x.root) for x in components.components(df).collect()}
        assert {k: v for k, v in got.items() if k in want} == want


# ---------------------------------------------------------------- all


def test_all_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))
