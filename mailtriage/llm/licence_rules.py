"""Licence recognition by sentence rules, in column expressions only.

1. A text is cut into sentences, once at every line end and once across line ends (for licence texts that
   are wrapped), and each sentence is normalised: ASCII lower case, everything but letters and digits
   one space.
2. Known licence sentences become identifiers. Up to GAP other sentences in a row are passed over; more of them
   leave a mark that no rule holds, so sentences far apart never make a licence.
3. Ordered rules, longest first, are sequences of identifiers. A rule replaces its occurrences by that mark
   before shorter rules see the sequence: a clause that belongs to a whole licence is not reported alone, and what
   stood left and right of it does not become neighbours.

Everything happens inside the row: no shuffle, no join. The sentence table is a constant of the plan.

Defined cases: null and empty texts have no sentences and no licences. Repeated rows each give a row. Other
columns of the input are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailtriage.llm.common import text_of

# Identifiers that a SPDX line may name.
SPDX = [
    "Apache-2.0", "MIT", "MIT-0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "MPL-2.0", "EPL-1.0", "EPL-2.0",
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later", "CC-BY-4.0", "CC-BY-SA-4.0", "MIT OR Apache-2.0", "Apache-2.0 OR MIT",
]
CC = {
    "cc-by": "attribution", "cc-by-sa": "attribution sharealike", "cc-by-nc": "attribution noncommercial", "cc-by-nd": "attribution noderivatives",
    "cc-by-nc-sa": "attribution noncommercial sharealike", "cc-by-nc-nd": "attribution noncommercial noderivatives",
}
_GNU = "you can redistribute it and or modify it under the terms of the gnu {} public license as published by the free software foundation"
_LATER = "of the license or at your option any later version"

# Public licence wording, normalised, by identifier.
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-notice-the": "licensed under the apache license version 2 0 the license",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-copy-at": "you may obtain a copy of the license at",
    "apache-address": "http www apache org licenses license 2 0",
    "apache-address-s": "https www apache org licenses license 2 0",
    "apache-asf": "the asf licenses this file to you under the apache license version 2 0 the license",
    "apache-title": "apache license",
    "apache-january": "version 2 0 january 2004",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-copy-s": "you may obtain a copy of the license at https www apache org licenses license 2 0",
    "mit-notice": "released under the mit license",
    "mit-title": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-program": "this program is free software",
    "gpl-modify-3": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-modify-2": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "mit-the-title": "the mit license",
    "mit-the-title-mit": "the mit license mit",
    "mit-licensed": "licensed under the mit license",
    "mit-distributed": "distributed under the mit license",
    "mit-project": "this project is licensed under the mit license",
    "isc-grant-and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "gpl-title": "gnu general public license",
    "lgpl-title": "gnu lesser general public license",
    "agpl-title": "gnu affero general public license",
    "gpl-june-2007": "version 3 29 june 2007",
    "gpl-june-1991": "version 2 june 1991",
    "lgpl-february-1999": "version 2 1 february 1999",
    "agpl-november-2007": "version 3 19 november 2007",
    "gpl-library": "this library is free software",
    "gpl-library-hope": "this library is distributed in the hope that it will be useful but without any warranty",
    "gpl-modify": f"{_GNU.format('general')}",
    "lgpl-modify": f"{_GNU.format('lesser general')}",
    "agpl-modify": f"{_GNU.format('affero general')}",
    "gnu-later-2": f"either version 2 {_LATER}",
    "gnu-later-2.1": f"either version 2 1 {_LATER}",
    "gnu-later-3": f"either version 3 {_LATER}",
    "gnu-only-2": "version 2 of the license",
    "gnu-only-3": "version 3 of the license",
    "lgpl-modify-2.1": f"{_GNU.format('lesser general')} either version 2 1 {_LATER}",
    "lgpl-modify-3": f"{_GNU.format('lesser general')} either version 3 {_LATER}",
    "agpl-modify-3": f"{_GNU.format('affero general')} either version 3 {_LATER}",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl-copy-s": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl-title": "mozilla public license version 2 0",
    "epl-1-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "epl-2-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl-1-title": "eclipse public license v 1 0",
    "epl-2-title": "eclipse public license v 2 0",
    "cc0-title": "cc0 1 0 universal",
    "cc0-software": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "boost-notice": "distributed under the boost software license version 1 0",
    "boost-title": "boost software license version 1 0 august 17th 2003",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "all-rights": "all rights reserved",
    "spdx": "spdx license identifier",
    **{f"spdx-{x}": x.lower().replace("-", " ").replace(".", " ") for x in SPDX},
    **{f"{k}-work": f"this work is licensed under a creative commons {v} 4 0 international license" for k, v in CC.items()},
    **{f"{k}-long": f"licensed under the creative commons {v} 4 0 international license" for k, v in CC.items()},
    **{f"{k}-short": f"licensed under {k.replace('-', ' ')} 4 0" for k in CC if k not in ("cc-by", "cc-by-nc", "cc-by-sa")},
}

# Rules in the order in which they are tried, those of several sentences before those of one: (licence, rule, sentence identifiers).
RULES = [
    *[("apache-2.0", "apache-header", [first, "apache-compliance", *rest]) for first in ("apache-notice-the", "apache-asf") for rest in (
        ["apache-copy-at", "apache-address", "apache-as-is"], ["apache-copy-at", "apache-address-s", "apache-as-is"],
        ["apache-copy", "apache-as-is"], ["apache-copy-s", "apache-as-is"])],
    ("bsd-3-clause", "bsd-3-text", ["all-rights", "bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("bsd-3-clause", "bsd-3-text", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("mit", "mit-text", ["mit-grant", "mit-keep", "mit-as-is"]),
    ("bsd-2-clause", "bsd-2-text", ["all-rights", "bsd-grant", "bsd-source", "bsd-binary"]),
    ("bsd-2-clause", "bsd-2-text", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("gpl-3.0-or-later", "gpl-3-header", ["gpl-program", "gpl-modify-3", "gpl-hope"]),
    ("gpl-2.0-or-later", "gpl-2-header", ["gpl-program", "gpl-modify-2", "gpl-hope"]),
    ("gpl-2.0-or-later", "gpl-2-header", ["gpl-program", "gpl-modify", "gnu-later-2", "gpl-hope"]),
    ("gpl-3.0-or-later", "gpl-3-header", ["gpl-program", "gpl-modify", "gnu-later-3", "gpl-hope"]),
    ("gpl-2.0-only", "gpl-2-only-header", ["gpl-program", "gpl-modify", "gnu-only-2", "gpl-hope"]),
    ("gpl-3.0-only", "gpl-3-only-header", ["gpl-program", "gpl-modify", "gnu-only-3", "gpl-hope"]),
    *[(f"{name}-{v}{x}-or-later", f"{name}-{v}-header", [f"gpl-{what}", *modify, hope])
      for name, v, x in (("lgpl", "2.1", ""), ("lgpl", "3", ".0"), ("agpl", "3", ".0"))
      for what, hope in (("library", "gpl-library-hope"), ("program", "gpl-hope"))
      for modify in ([f"{name}-modify-{v}"], [f"{name}-modify", f"gnu-later-{v}"])],
    ("zlib", "zlib-text", ["zlib-as-is", "zlib-liable", "zlib-grant"]),
    ("mpl-2.0", "mpl-header", ["mpl-form", "mpl-copy"]),
    ("mpl-2.0", "mpl-header", ["mpl-form", "mpl-copy-s"]),
    ("epl-1.0", "epl-1-header", ["all-rights", "epl-1-notice"]),
    ("epl-2.0", "epl-2-header", ["all-rights", "epl-2-notice"]),
    ("apache-2.0", "apache-text", ["apache-title", "apache-january"]),
    ("gpl-3.0", "gpl-3-text", ["gpl-title", "gpl-june-2007"]),
    ("gpl-2.0", "gpl-2-text", ["gpl-title", "gpl-june-1991"]),
    ("lgpl-3.0", "lgpl-3-text", ["lgpl-title", "gpl-june-2007"]),
    ("lgpl-2.1", "lgpl-2.1-text", ["lgpl-title", "lgpl-february-1999"]),
    ("agpl-3.0", "agpl-3-text", ["agpl-title", "agpl-november-2007"]),
    *[(f"{name}-{v}{x}-or-later", f"{name}-{v}-clause", [f"{name}-modify", f"gnu-later-{v}"])
      for name, v, x in (("gpl", "2", ".0"), ("gpl", "3", ".0"), ("lgpl", "2.1", ""), ("lgpl", "3", ".0"), ("agpl", "3", ".0"))],
    *[(x.lower(), "spdx-line", ["spdx", f"spdx-{x}"]) for x in SPDX],
    ("apache-2.0", "apache-notice", ["apache-notice"]),
    ("apache-2.0", "apache-short", ["apache-notice-the"]),
    ("mit", "mit-notice", ["mit-notice"]),
    ("mit", "mit-title", ["mit-title"]),
    ("mit", "mit-grant", ["mit-grant"]),
    ("gpl-3.0-only", "gpl-3-notice", ["gpl3-notice"]),
    ("gpl-3.0-or-later", "gpl-3-clause", ["gpl-modify-3"]),
    ("gpl-2.0-or-later", "gpl-2-clause", ["gpl-modify-2"]),
    ("cc-by-nc-4.0", "cc-by-nc-notice", ["cc-by-nc-notice"]),
    ("cc-by-sa-4.0", "cc-by-sa-notice", ["cc-by-sa-notice"]),
    ("cc-by-4.0", "cc-by-notice", ["cc-by-notice"]),
    ("isc", "isc-text", ["isc-grant"]),
    ("unlicense", "unlicense-text", ["unlicense"]),
    *[("mit", x, [x]) for x in ("mit-the-title", "mit-the-title-mit", "mit-licensed", "mit-distributed", "mit-project")],
    ("isc", "isc-text-and", ["isc-grant-and"]),
    ("0bsd", "0bsd-text", ["0bsd-grant"]),
    ("lgpl-2.1-or-later", "lgpl-2.1-clause", ["lgpl-modify-2.1"]),
    ("lgpl-3.0-or-later", "lgpl-3-clause", ["lgpl-modify-3"]),
    ("agpl-3.0-or-later", "agpl-3-clause", ["agpl-modify-3"]),
    *[("mpl-2.0", x, [x]) for x in ("mpl-form", "mpl-copy", "mpl-copy-s", "mpl-title")],
    *[(f"epl-{x}.0", f"epl-{x}-{k}", [f"epl-{x}-{k}"]) for x in "12" for k in ("notice", "title")],
    *[("cc0-1.0", x, [x]) for x in ("cc0-title", "cc0-software")],
    *[("boost-1.0", x, [x]) for x in ("boost-notice", "boost-title", "boost-grant")],
    ("zlib", "zlib-grant", ["zlib-grant"]),
    *[(f"{k}-4.0", f"{k}-{x}", [f"{k}-{x}"]) for k in CC for x in ("work", "long", "short") if f"{k}-{x}" in SENTENCES],
    ("all-rights-reserved", "all-rights", ["all-rights"]),
]

# Ends of sentences: punctuation before white space or the end; every line end in the first reading, lines that are blank but for comment signs in the second.
BY_LINE = r"[.;:!?]+(?:[ \t\r\n]|\z)|[\r\n]"
ACROSS = r"[.;:!?]+(?:[ \t\r\n]|\z)|\n[ \t\r*#/%-]*\n"
NOT_WORD = "[^a-z0-9|]+"

# Unknown sentences that may stand between two sentences of one rule, and the mark of more of them or of a rule's place.
GAP = 8
MARK = "#"
LONG_GAP = f"[.]{{{GAP + 1},}}"


def _codes() -> dict[str, str]:
    return {name: f"<{i}>" for i, name in enumerate(SENTENCES)}


def sequence_of(text: Column, ends: str) -> Column:
    """Identifiers of the known sentences of a text, in order, as one string."""
    codes = _codes()
    table = F.create_map(*[F.lit(x) for name, sentence in SENTENCES.items() for x in (sentence, codes[name])])
    marked = F.regexp_replace(F.lower(F.translate(text, "|", " ")), ends, "|")
    sentences = F.split(F.regexp_replace(marked, NOT_WORD, " "), " *[|] *")
    other = lambda s: F.when(F.trim(s) == "", "").otherwise(".")
    sequence = F.array_join(F.transform(sentences, lambda s: F.coalesce(F.try_element_at(table, F.trim(s)), other(s))), "")
    return F.replace(F.regexp_replace(sequence, LONG_GAP, MARK), F.lit("."), F.lit(""))


def with_licences(docs: DataFrame) -> DataFrame:
    """``docs`` with licences (names in rule order), rules (counted as rule*n, first reading and second) and sentence_count."""
    codes = _codes()
    patterns = ["".join(codes[s] for s in rule) for _, _, rule in RULES]
    several = max(i for i, (_, _, rule) in enumerate(RULES) if len(rule) > 1) + 1

    def count(sequence, pattern):
        return F.floor((F.length(sequence) - F.length(F.replace(sequence, pattern, F.lit("")))) / F.length(pattern)).cast("int")

    def step(state, pattern):
        n = F.greatest(count(state["line"], pattern), count(state["wrapped"], pattern))
        return F.struct(F.replace(state["line"], pattern, F.lit(MARK)).alias("line"), F.replace(state["wrapped"], pattern, F.lit(MARK)).alias("wrapped"), F.concat(state["n"], F.array(n)).alias("n"))

    literals = lambda values: F.array(*[F.lit(x) for x in values])
    first = F.struct(F.col("__r0.line").alias("line"), F.col("__r0.wrapped").alias("wrapped"), F.array().cast("array<int>").alias("n"))
    out = docs.withColumn("__r0", F.struct(sequence_of(text_of(), BY_LINE).alias("line"), sequence_of(text_of(), ACROSS).alias("wrapped")))
    # Each rule takes its occurrences out of the sequence that the next rule sees. Rules of one sentence come last and take nothing from one another.
    some = F.contains("__r0.line", F.lit("<")) | F.contains("__r0.wrapped", F.lit("<"))
    out = out.withColumn("__r1", F.when(some, F.aggregate(literals(patterns[:several]), first, step)))
    alone = F.transform(literals(patterns[several:]), lambda p: F.greatest(count(F.col("__r1.line"), p), count(F.col("__r1.wrapped"), p)))
    out = out.withColumn("__n", F.when(some, F.concat("__r1.n", alone)).otherwise(F.array().cast("array<int>")))
    table = literals([x[0] for x in RULES]), literals([x[1] for x in RULES])
    hits = F.filter(F.transform("__n", lambda n, i: F.struct(n.alias("n"), F.get(table[0], i).alias("licence"), F.get(table[1], i).alias("rule"))), lambda h: h["n"] > 0)
    out = out.withColumn("__hits", hits)
    rules = F.transform("__hits", lambda h: F.concat(h["rule"], F.lit("*"), h["n"].cast("string")))
    known = F.length(F.regexp_replace("__r0.line", f"[0-9>{MARK}]", ""))
    return out.withColumns({"licences": F.array_distinct(F.transform("__hits", lambda h: h["licence"])), "rules": rules, "sentence_count": known}).drop("__r0", "__r1", "__n", "__hits")
