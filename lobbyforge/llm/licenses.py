"""Licence scans by sentence rules.

A text is cut into pieces (at line ends, after ``. ! ?`` with a blank, at commas, semicolons and
brackets), which become words: A-Z lower-cased, runs of other ASCII signs and of typographic quotes
one blank.  Slots are filled first: a named holder where licences leave room for one reads as the
copyright holder, ``this file is licensed`` as ``licensed``, and an SPDX expression as an identifier for each
licence in it, without exceptions.  A known sentence is found where one piece, or several with no blank line between them (wrapped
lines, or ``v. 2.0``), are its words and no more.  Of those that begin together the longest
counts, and the next is sought behind it.  A table maps sentences to identifiers; those of a
document form a sequence.  Rules are tried in order; a rule names a licence and the
identifiers that must follow one another, with none between, in the document's sequence.
Identifiers that a rule has used stay in their places but no later rule sees them.  A licence
is reported once, at the first of its rules that matches; a reservation of all rights only where there
is no licence.

Everything is done within a row, by column functions: nothing is shuffled.  Null and
empty texts have no sentences and no licences.  Repeated rows stay; an empty table gives an
empty one.  Columns ``license_ids`` and ``licenses`` of the input are replaced, others stay as
they are.  A very long text is one value of one row: it costs a few copies of itself, in turn.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: Normalised licence sentences and their identifiers (fixed values; wording of the public licences).
SENTENCES = {
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is, without warranty of any kind, express or implied": "AsIs",
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdNoEndorse",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "IscGrant",
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "this project is licensed under the mit license": "MitRef",
    "spdx-license-identifier: mit": "MitRef",
    "licensed under the apache license, version 2.0": "Apache2Ref",
    "licensed under the apache license, version 2.0 (the license)": "Apache2Ref",
    "you may not use this file except in compliance with the license": "Apache2Comply",
    "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied": "Apache2AsIs",
    "spdx-license-identifier: apache-2.0": "Apache2Ref",
    "licensed under the bsd 3-clause license": "Bsd3Ref",
    "spdx-license-identifier: bsd-3-clause": "Bsd3Ref",
    "licensed under the bsd 2-clause license": "Bsd2Ref",
    "spdx-license-identifier: bsd-2-clause": "Bsd2Ref",
    "this work is licensed under the gnu general public license, version 3": "Gpl3Ref",
    "licensed under the gnu general public license, version 3": "Gpl3Ref",
    "licensed under the gnu general public license, version 2": "Gpl2Ref",
    "this program is distributed in the hope that it will be useful, but without any warranty": "GplHope",
    "spdx-license-identifier: gpl-3.0-only": "Gpl3Ref",
    "spdx-license-identifier: gpl-2.0-only": "Gpl2Ref",
    "licensed under the gnu lesser general public license, version 3": "Lgpl3Ref",
    "licensed under the gnu affero general public license, version 3": "Agpl3Ref",
    "this source code form is subject to the terms of the mozilla public license, v. 2.0": "Mpl2Ref",
    "licensed under cc by-nc 4.0": "CcByNc4Ref",
    "licensed under cc by 4.0": "CcBy4Ref",
    "licensed under cc by-sa 4.0": "CcBySa4Ref",
    "this work is licensed under a creative commons attribution 4.0 international license": "CcBy4Ref",
    "this work is licensed under a creative commons attribution-noncommercial 4.0 international license": "CcByNc4Ref",
    "this work is licensed under a creative commons attribution-sharealike 4.0 international license": "CcBySa4Ref",
    "this work is dedicated to the public domain": "PublicDomain",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "all rights reserved": "Reserved",
}
#: Sentences of the official texts, and what they contain (fixed values; wording of the public licences).
OFFICIAL = {
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions": ("MitGrant",),
    "the above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the software": ("MitNotice",),
    "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement": ("AsIs",),
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": ("AsIs",),
    "the software is provided as is and isc disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": ("AsIs",),
    "in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software": ("MitLiability",),
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": ("IscGrant",),
    "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": ("IscGrant",),
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed": ("BsdAsIs",),
    "neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": ("BsdNoEndorse",),
    "licensed under the apache license, version 2.0 (the license); you may not use this file except in compliance with the license": ("Apache2Ref", "Apache2Comply"),
    "apache license version 2.0, january 2004": ("Apache2Title",),
    "terms and conditions for use, reproduction, and distribution": ("Apache2Terms",),
    "subject to the terms and conditions of this license, each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare derivative works of, publicly display, publicly perform, sublicense, and distribute the work and such derivative works in source or object form": ("Apache2Grant",),
    "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose": ("GplHope",),
    "this library is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose": ("GplHope",),
    "everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed": ("FsfVerbatim",),
    "gnu general public license version 2, june 1991": ("Gpl2Title",),
    "gnu general public license version 3, 29 june 2007": ("Gpl3Title",),
    "gnu lesser general public license version 2.1, february 1999": ("Lgpl21Title",),
    "gnu lesser general public license version 3, 29 june 2007": ("Lgpl3Title",),
    "gnu affero general public license version 3, 19 november 2007": ("Agpl3Title",),
    "mozilla public license version 2.0": ("Mpl2Title",),
    "if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/": ("Mpl2Copy",),
    "if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/": ("Mpl2Copy",),
    "licensed under the gnu lesser general public license, version 2.1": ("Lgpl21Ref",),
    "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/": ("Mpl2Ref", "Mpl2Copy"),
}
#: Grants of the GNU licences: what is granted, version, sign before and behind "either", identifier.
GNU = (
    ("general", "2", ";", "Gpl2Grant"), ("general", "3", ":", "Gpl3Grant"), ("lesser general", "2.1", ";", "Lgpl21Grant"),
    ("lesser general", "3", ":", "Lgpl3Grant"), ("affero general", "3", ":", "Agpl3Grant"),
)
OFFICIAL |= {
    f"this {thing} is free software{sign} you can redistribute it and/or modify it under the terms of the gnu {kind} public license as published by the free software foundation{sign} either version {version} of the license, or (at your option) any later version": (name,)
    for kind, version, sign, name in GNU
    for thing in ("program", "library")
}
#: Licences with a short identifier that files state as ``SPDX-License-Identifier``.
SPDX = (
    "ISC", "MPL-2.0", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense",
)
OFFICIAL |= {f"spdx-license-identifier: {name.lower()}": (f"Spdx-{name}",) for name in SPDX}
#: (licence, identifiers in sequence), the most specific first (fixed values).
RULES = (
    ("MIT", ("MitGrant", "MitNotice", "AsIs")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdNoEndorse")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("Apache-2.0", ("Apache2Title", "Apache2Terms", "Apache2Grant")),
    ("Apache-2.0", ("Apache2Ref", "Apache2Comply", "Apache2AsIs")),
    *((f"{name}-only", (title, "FsfVerbatim")) for name, title in (("GPL-2.0", "Gpl2Title"), ("GPL-3.0", "Gpl3Title"), ("LGPL-2.1", "Lgpl21Title"), ("LGPL-3.0", "Lgpl3Title"), ("AGPL-3.0", "Agpl3Title"))),
    ("GPL-3.0-or-later", ("Gpl3Grant", "GplHope")),
    ("GPL-2.0-or-later", ("Gpl2Grant", "GplHope")),
    ("LGPL-2.1-or-later", ("Lgpl21Grant", "GplHope")),
    ("LGPL-3.0-or-later", ("Lgpl3Grant", "GplHope")),
    ("AGPL-3.0-or-later", ("Agpl3Grant", "GplHope")),
    ("MPL-2.0", ("Mpl2Ref", "Mpl2Copy")),
    ("ISC", ("IscGrant", "AsIs")),
    ("MIT", ("MitGrant",)),
    ("MIT", ("MitRef",)),
    ("Apache-2.0", ("Apache2Ref",)),
    ("BSD-3-Clause", ("Bsd3Ref",)),
    ("BSD-2-Clause", ("Bsd2Ref",)),
    ("GPL-3.0-or-later", ("Gpl3Grant",)),
    ("GPL-2.0-or-later", ("Gpl2Grant",)),
    ("LGPL-2.1-or-later", ("Lgpl21Grant",)),
    ("LGPL-3.0-or-later", ("Lgpl3Grant",)),
    ("AGPL-3.0-or-later", ("Agpl3Grant",)),
    ("GPL-3.0-only", ("Gpl3Ref",)),
    ("GPL-2.0-only", ("Gpl2Ref",)),
    ("LGPL-2.1-only", ("Lgpl21Ref",)),
    ("LGPL-3.0-only", ("Lgpl3Ref",)),
    ("AGPL-3.0-only", ("Agpl3Ref",)),
    ("MPL-2.0", ("Mpl2Ref",)),
    ("MPL-2.0", ("Mpl2Title",)),
    ("CC-BY-NC-4.0", ("CcByNc4Ref",)),
    ("CC-BY-SA-4.0", ("CcBySa4Ref",)),
    ("CC-BY-4.0", ("CcBy4Ref",)),
    *((name, (f"Spdx-{name}",)) for name in SPDX),
    ("ISC", ("IscGrant",)),
    ("Unlicense", ("Unlicense",)),
    ("Public-Domain", ("PublicDomain",)),
    ("All-Rights-Reserved", ("Reserved",)),
)
#: Cut points (fixed values); what stands between words, line ends and the signs of CLAUSE being kept.
CUT = r"([.!?])[ \t]+"
BETWEEN = "[\\x00-\\x09\\x0B-'*+\\-./:<-@\\[-`{-\\x7F\u00a0\u201c\u201d\u2018\u2019\u00ab\u00bb]+"
CLAUSE = " ?\n? ?(?:[,;()] ?)+\n? ?"
#: (slot, what it reads as), over words set apart by one blank or line end (fixed values of the public licences).
W = "[ \n]"
SLOTS = tuple((p.replace(" ", W), r) for p, r in (
    ("(neither the name of)(?: [a-z0-9]+){1,12}?( nor the names of (?:its|the|their|any) contributors)", "\\1 the copyright holder\\2"),
    ("(nor the names of) (?:the|their|any) (contributors)", "\\1 its \\2"),
    ("(this software is provided by)(?: [a-z0-9]+){1,12}?( as is and any express or implied)", "\\1 the copyright holders and contributors\\2"),
)) + ((f"(^|\n)this{W}(?:file|project|software|program|library|code|package|repository|module){W}is{W}(licensed|released){W}under", "\\1\\2 under"),)
#: A line of an SPDX expression, its exceptions, and the place where it goes on with another licence.
SPDX_LINE, SPDX_EXCEPTION = r"spdx-license-identifier:[^\n]*", r"(spdx-license-identifier:[^\n]*?)[ \t]+with[ \t]+[a-z0-9.\-]+"
SPDX_JOIN, SPDX_NEXT = r"(spdx-license-identifier:[^\n]*?)[ \t)]+(?:or|and)[ \t(]+", "\\1\nspdx-license-identifier: "


def words_of(sentence: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", sentence))


KNOWN = {words_of(s): (i,) for s, i in SENTENCES.items()} | {words_of(s): ids for s, ids in OFFICIAL.items()}
#: Every known sentence has one of these within a word (checked by a test): a text without any has none.
HINTS = "licens|permi|redistribut|copyright|warrant|reserved|domain|software|endorse|compliance|applicable|unencumbered|conditions|mpl"


def java(replacement: str) -> str:
    """A replacement with groups as ``\\1``, as DuckDB has them, for Spark."""
    return re.sub(r"\\\\?([0-9])", r"$\1", replacement)


def expressions(low: Column) -> Column:
    """SPDX expressions as a line for each licence, as often as the longest of them goes on."""
    lines = F.regexp_extract_all(low, F.lit(SPDX_LINE), F.lit(0))
    joins = F.coalesce(F.array_max(F.transform(lines, lambda x: F.regexp_count(x, F.lit("[ )](?:or|and)[ (]")))), F.lit(0))
    bare = F.regexp_replace(low, SPDX_EXCEPTION, "$1")
    split = F.aggregate(F.sequence(F.lit(1), F.greatest(joins, F.lit(1))), bare, lambda t, _: F.regexp_replace(t, SPDX_JOIN, java(SPDX_NEXT)))
    return F.when(low.contains("spdx-license-identifier:"), split).otherwise(low)


def pieces_of(text: Column) -> Column:
    """Words of a text, set apart by blanks within pieces and line ends between them."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(expressions(text), CUT, "$1\n"), BETWEEN, " "), CLAUSE, "\n"), " ?\n ?", "\n")
    for slot, reads in SLOTS:
        out = F.regexp_replace(out, slot, java(reads))
    return F.trim(out)


def sentence_ids(text: Column) -> Column:
    """Identifiers of the licence sentences of a text, in order.

    Texts without any word of licences are passed over before the costly steps.
    """
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    pieces = F.concat(F.lit("\n"), pieces_of(low), F.lit("\n"))
    longest_first = sorted(KNOWN, key=lambda s: (-len(s), s))
    pattern = "\n(" + "|".join(s.replace(" ", "[ \n]") for s in longest_first) + ")(?=\n)"
    known = F.create_map(*(x for s, ids in KNOWN.items() for x in (F.lit(s), F.array(*map(F.lit, ids)))))
    found = F.transform(F.regexp_extract_all(pieces, F.lit(pattern), F.lit(1)), lambda s: F.try_element_at(known, F.translate(s, "\n", " ")))
    return F.when(low.rlike(HINTS), F.flatten(found)).otherwise(F.array().cast("array<string>"))


#: What stands in the place of identifiers that a rule has used.
USED = "|.|"


def match_rules(ids: Column) -> Column:
    """Licences of a sequence of identifiers, in the order of the rules: a fold over the rules."""
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f"|{i}|" for i in sequence)).alias("ids")) for name, sequence in RULES))
    start = F.struct(F.concat(F.lit("|"), F.array_join(ids, "||"), F.lit("|")).alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        hit = state["rest"].contains(rule["ids"])
        found = F.when(hit, F.concat(state["found"], F.array(rule["name"]))).otherwise(state["found"])
        return F.struct(F.replace(state["rest"], rule["ids"], F.lit(USED)).alias("rest"), found.alias("found"))

    return F.aggregate(rules, start, step, lambda state: granted(F.array_distinct(state["found"])))


#: What a text claims that grants nothing.
RESERVED = "All-Rights-Reserved"


def granted(found: Column) -> Column:
    return F.when(F.size(found) > 1, F.array_remove(found, RESERVED)).otherwise(found)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with ``license_ids`` and ``licenses`` (arrays of strings)."""
    ids = docs.withColumn("license_ids", sentence_ids(F.col(text)))
    return ids.withColumn("licenses", licences_once(F.col("license_ids")))


def licences_once(ids: Column) -> Column:
    return F.when(F.size(ids) == 0, F.array().cast("array<string>")).otherwise(match_rules(ids))
