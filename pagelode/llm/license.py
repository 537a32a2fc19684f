"""License scans by sentence rules.

Texts are cut into sentences at full stops and blank lines (not at semicolons, which stand
inside sentences of licences, nor after the "v." of a version), and sentences are normalised
(letters and digits in lower case, single spaces), so that line breaks and punctuation do
not matter. Known licence sentences are found as runs of words inside a sentence, the
longest first, and become identifiers; each document's sequence of identifiers is matched
against ordered rules. The first rule that fits takes its sentences away, so that a longer
licence is not read again as a shorter one; other identifiers may stand between those of
a rule and stay for the rules after it. Only texts with a word that every known sentence
needs are cut at all.

Defined cases: null or empty text has no sentence; repeated rows are documents of their
own; a sentence that occurs twice counts twice and its licence is reported once; of known
sentences that begin at the same word the longest counts; known sentences that no rule
takes are reported as ``unmatched``; very long texts are read whole; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every known sentence holds one of these words.
NEEDED = r"licen[sc]e|copyright|permission|redistribut|warrant|spdx|public domain|the mpl|free to copy|creative\s+commons"

#: Licences that texts refer to by name: SPDX identifier, then normalised names.
NAMES = {
    "AGPL-3.0": ("gnu affero general public license version 3", "agpl 3 0 license"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license"),
    "Artistic-2.0": ("artistic license 2 0",),
    "BSD-2-Clause": ("2 clause bsd license", "simplified bsd license", "bsd 2 clause license"),
    "BSD-3-Clause": ("3 clause bsd license", "new bsd license", "modified bsd license", "bsd 3 clause license"),
    "BSL-1.0": ("boost software license version 1 0",),
    "CDDL-1.0": ("common development and distribution license version 1 0",),
    "EPL-2.0": ("eclipse public license 2 0", "eclipse public license v 2 0"),
    "GPL-2.0": ("gnu general public license version 2", "gpl v2 license"),
    "GPL-3.0": ("gnu general public license version 3", "gpl v3 license"),
    "ISC": ("isc license",),
    "LGPL-2.1": ("gnu lesser general public license version 2 1",),
    "LGPL-3.0": ("gnu lesser general public license version 3",),
    "MIT": ("mit license",),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license v 2 0", "mpl 2 0 license"),
    "Zlib": ("zlib license",),
}
#: Words before a name, and names of Creative Commons licences.
REFERENCES = ("licensed under the", "released under the", "distributed under the", "made available under the", "published under the")
CREATIVE = {
    "BY": "attribution",
    "BY-SA": "attribution sharealike",
    "BY-NC": "attribution noncommercial",
    "BY-ND": "attribution noderivatives",
    "BY-NC-SA": "attribution noncommercial sharealike",
    "BY-NC-ND": "attribution noncommercial noderivatives",
}
#: Licences whose tags tell one version from all later ones.
VERSIONED = ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")
VERSIONS = ("4.0", "3.0")

#: Identifiers and normalised sentences of licence texts and headers.
TEXTS = [
    ("apache-not", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at"),
    ("as-is-dist", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("see-license", "see the license for the specific language governing permissions and limitations under the license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd-use", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-names", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-names", "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-warranty", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("gpl2-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl3-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl2-only", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl2-only", "this program is free software you can redistribute it and or modify it under the terms of version 2 of the gnu general public license as published by the free software foundation"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-details", "see the gnu general public license for more details"),
    ("gpl-received", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl21-later", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl3-later", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-hope", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl-details", "see the gnu lesser general public license for more details"),
    ("agpl-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-details", "see the gnu affero general public license for more details"),
    ("mpl-subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-obtain", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-warranty", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("epl-made", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("epl-made", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0"),
    ("bsl-grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software"),
    ("zlib-warranty", "this software is provided as is without any express or implied warranty"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("unlicense-free", "this is free and unencumbered software released into the public domain"),
    ("unlicense-anyone", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc0-waive", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc0-name", "licensed under cc0 1 0"),
    ("wtfpl-name", "do what the fuck you want to public license"),
]


def _plain(name: str) -> str:
    return name.lower().replace("-", " ").replace(".", " ")


def _references() -> list[tuple[str, str]]:
    """Identifiers and sentences that name a licence, built from the tables above."""
    out = [(f"ref-{_plain(k).replace(' ', '-')}", f"{before} {name}") for k, names in NAMES.items() for name in names for before in REFERENCES]
    out += [(f"spdx-{_plain(k).replace(' ', '-')}", f"spdx license identifier {_plain(k)}") for k in NAMES]
    out += [(f"spdx-{_plain(k).replace(' ', '-')}-{end.replace(' ', '-')}", f"spdx license identifier {_plain(k)} {end}") for k in VERSIONED for end in ("only", "or later")]
    for kind, full in CREATIVE.items():
        for v in VERSIONS:
            i = f"cc-{kind.lower()}-{v[0]}"
            out += [(i, f"licensed under cc {_plain(kind)} {_plain(v)}"), (i, f"licensed under a creative commons {_plain(kind)} {_plain(v)} license"), (i, f"spdx license identifier cc {_plain(kind)} {_plain(v)}")]
            out.append((i, f"creative commons {full} {_plain(v)}"))
    return out


SENTENCES = TEXTS + _references()

#: Licences and the sequences that show them, in the order they are tried; a licence's name alone comes last.
RULES = [
    ("Apache-2.0", ["ref-apache-2-0", "apache-not", "apache-copy", "as-is-dist", "see-license"]),
    ("Apache-2.0", ["ref-apache-2-0", "apache-not", "apache-copy"]),
    ("BSD-3-Clause", ["bsd-use", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty"]),
    ("BSD-3-Clause", ["bsd-use", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-use", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("BSD-2-Clause", ["bsd-use", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("BSL-1.0", ["bsl-grant", "mit-warranty"]),
    ("BSL-1.0", ["bsl-grant"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("ISC", ["isc-grant"]),
    ("Zlib", ["zlib-warranty", "zlib-grant"]),
    ("GPL-3.0-or-later", ["gpl3-later", "gpl-hope", "gpl-details", "gpl-received"]),
    ("GPL-3.0-or-later", ["gpl3-later", "gpl-hope", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-hope", "gpl-details", "gpl-received"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("GPL-2.0-only", ["gpl2-only", "gpl-hope", "gpl-details", "gpl-received"]),
    ("GPL-2.0-only", ["gpl2-only", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("AGPL-3.0-or-later", ["agpl-later", "gpl-hope", "agpl-details"]),
    ("AGPL-3.0-or-later", ["agpl-later"]),
    ("LGPL-2.1-or-later", ["lgpl21-later", "lgpl-hope", "lgpl-details"]),
    ("LGPL-2.1-or-later", ["lgpl21-later"]),
    ("LGPL-3.0-or-later", ["lgpl3-later", "lgpl-hope", "lgpl-details"]),
    ("LGPL-3.0-or-later", ["lgpl3-later"]),
    ("MPL-2.0", ["mpl-subject", "mpl-obtain"]),
    ("MPL-2.0", ["mpl-subject"]),
    ("EPL-2.0", ["epl-made"]),
    ("Unlicense", ["unlicense-free", "unlicense-anyone"]),
    ("Unlicense", ["unlicense-free"]),
    ("CC0-1.0", ["cc0-waive"]),
    ("CC0-1.0", ["cc0-name"]),
    ("WTFPL", ["wtfpl-name"]),
]
RULES += [(k, [f"{form}-{_plain(k).replace(' ', '-')}"]) for k in NAMES for form in ("ref", "spdx")]
RULES += [(f"{k}-{end}", [f"spdx-{_plain(k).replace(' ', '-')}-{end}"]) for k in VERSIONED for end in ("only", "or-later")]
RULES += [(f"CC-{kind}-{v}", [f"cc-{kind.lower()}-{v[0]}"]) for kind in CREATIVE for v in VERSIONS]

#: All sentences as one pattern, the longest first.
KNOWN = r"\b(?:" + "|".join(sorted({s for _, s in SENTENCES}, key=lambda s: (-len(s), s))) + r")\b"
#: A full stop that ends no sentence.
VERSION = r"\bv\.\s+"
#: What may stand between two identifiers of a rule.
_GAP = "((?:,[^,]+,)*?)"


def normalised(text: Column) -> Column:
    """All sentences in one line: words of a-z and 0-9, sentences apart by a full stop."""
    whole = F.regexp_replace(F.lower(text), VERSION, "v ")
    cut = F.regexp_replace(whole, r"[.!?]+(\s+|$)|\n[ \t\r]*\n", "\x01")
    return F.regexp_replace(F.regexp_replace(cut, "[^a-z0-9\x01]+", " "), " ?\x01[ \x01]*", " . ")


def rule_pattern(ids: list[str]) -> tuple[str, int]:
    """The pattern of a rule's identifiers in order, and how many gaps it holds."""
    return _GAP.join(f",{i}," for i in ids), len(ids) - 1


def _left(n: int, mark: str) -> str:
    """What a rule leaves: the gaps, and a bar for each identifier it takes."""
    return ",|," + "".join(f"{mark}{k},|," for k in range(1, n + 1))


def match_rules(sequence: Column) -> tuple[Column, Column]:
    """(licences, what is left) for a sequence ``,id,,id,``; rules apply in order."""
    rules = F.array(
        *(F.struct(F.lit(name).alias("name"), F.lit(p).alias("pattern"), F.lit(_left(gaps, "$")).alias("leaves")) for name, (p, gaps) in ((n, rule_pattern(i)) for n, i in RULES))
    )
    none = F.array().cast("array<string>")

    def apply(state: Column, rule: Column) -> Column:
        fits = F.call_function("rlike", state["left"], rule["pattern"])
        return F.struct(
            F.when(fits, F.regexp_replace(state["left"], rule["pattern"], rule["leaves"])).otherwise(state["left"]).alias("left"),
            F.when(fits, F.array_append(state["names"], rule["name"])).otherwise(state["names"]).alias("names"),
        )

    start = F.struct(sequence.alias("left"), none.alias("names"))
    done = F.when(sequence != ",", F.aggregate(rules, start, apply)).otherwise(start)
    return F.array_sort(F.array_distinct(done["names"])), done["left"]


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sequence, licenses, unmatched."""
    # no shuffle: the fixed table is a literal map
    ids = F.create_map(*(F.lit(x) for s, i in {s: i for i, s in SENTENCES}.items() for x in (s, i)))
    found = F.transform(F.regexp_extract_all(normalised(F.col("text")), F.lit(KNOWN), F.lit(0)), lambda s: F.element_at(ids, s))
    none = F.array().cast("array<string>")
    seen = docs.select("doc_id", F.when(F.lower("text").rlike(NEEDED), found).otherwise(none).alias("found"))
    sequence = F.concat(F.lit(","), F.array_join("found", ",,"), F.lit(","))
    staged = seen.withColumn("sequence", F.when(F.size("found") > 0, sequence).otherwise(","))
    licenses, left = match_rules(F.col("sequence"))
    rest = F.filter(F.split(left, ","), lambda x: (x != "") & (x != "|"))
    return staged.select(
        "doc_id",
        F.size("found").cast("long").alias("n_sentences"),
        F.array_join("found", ",").alias("sequence"),
        F.array_join(licenses, ",").alias("licenses"),
        F.array_join(rest, ",").alias("unmatched"),
    )


def oracle_sql() -> str:
    """DuckDB SQL of :func:`license_scan`."""
    values = ", ".join(f"('{i}', '{s}')" for i, s in SENTENCES)
    steps, names = ["s0 AS (SELECT *, CASE WHEN len(found) > 0 THEN ',' || array_to_string(found, ',,') || ',' ELSE ',' END AS q0 FROM f)"], {}
    for k, (name, ids) in enumerate(RULES):
        pattern, gaps = rule_pattern(ids)
        names.setdefault(name, []).append(f"h{k}")
        left = _left(gaps, "\\")
        steps.append(f"s{k + 1} AS (SELECT *, regexp_matches(q{k}, '{pattern}') AS h{k}, regexp_replace(q{k}, '{pattern}', '{left}', 'g') AS q{k + 1} FROM s{k})")
    hits = ", ".join(f"CASE WHEN {' OR '.join(h)} THEN '{n}' END" for n, h in names.items())
    last = f"q{len(RULES)}"
    line = f"regexp_replace(regexp_replace(lower(text), '{VERSION}', 'v ', 'g'), '[.!?]+(\\s+|$)|\\n[ \\t\\r]*\\n', chr(1), 'g')"
    line = f"regexp_replace(regexp_replace({line}, '[^a-z0-9\\x01]+', ' ', 'g'), ' ?\\x01[ \\x01]*', ' . ', 'g')"
    return f"""
WITH k(id, sentence) AS (SELECT DISTINCT * FROM (VALUES {values})),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
c AS (
  SELECT r, unnest(found) AS s, generate_subscripts(found, 1) AS place
  FROM (SELECT r, regexp_extract_all({line}, '{KNOWN}') AS found FROM d WHERE regexp_matches(lower(text), '{NEEDED}'))
),
m AS (SELECT r, list(k.id ORDER BY place) AS found FROM c JOIN k ON k.sentence = s GROUP BY r),
f AS (SELECT d.doc_id, coalesce(m.found, []) AS found FROM d LEFT JOIN m USING (r)),
{", ".join(steps)}
SELECT doc_id, CAST(len(found) AS BIGINT) AS n_sentences, coalesce(array_to_string(found, ','), '') AS sequence,
       coalesce(array_to_string(list_sort(list_filter([{hits}], lambda x: x IS NOT NULL)), ','), '') AS licenses,
       coalesce(array_to_string(list_filter(string_split({last}, ','), lambda x: x <> '' AND x <> '|'), ','), '') AS unmatched
FROM s{len(RULES)}
"""
