"""Licence scans by sentence rules, in DataFrame functions only.

A text is normalised to words, blanks, line ends and stops, known licence sentences are searched in it between two line ends
or stops, and the sequence of the identifiers found is matched against ordered rules. Nothing is shuffled: the whole scan
is a projection of each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.llm.tables import read

# Known sentences of public licences, lower case, with single blanks for all that is neither letter nor digit.
SENTENCES = {
    1: "licensed under the apache license version 2 0",
    2: "licensed under the apache license version 2 0 the license",
    3: "you may not use this file except in compliance with the license",
    4: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    5: "see the license for the specific language governing permissions and limitations under the license",
    10: "released under the mit license",
    11: "licensed under the mit license",
    12: "the mit license mit",
    13: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    14: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    15: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    16: "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    17: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    20: "this work is licensed under the gnu general public license version 3",
    21: "this work is licensed under the gnu general public license version 2",
    22: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    23: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    24: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    25: "you should have received a copy of the gnu general public license along with this program",
    26: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    27: "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    28: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    29: "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    30: "licensed under cc by nc 4 0",
    31: "licensed under cc by 4 0",
    32: "licensed under cc by sa 4 0",
    33: "this work is licensed under a creative commons attribution 4 0 international license",
    34: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    35: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    36: "licensed under cc0 1 0",
    37: "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    40: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    41: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    42: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    43: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    44: "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    45: "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services",
    46: "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    47: "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    48: "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    49: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    50: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    51: "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    52: "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    60: "this source code form is subject to the terms of the mozilla public license v 2 0",
    61: "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    62: "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    63: "mozilla public license version 2 0",
    64: "this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0",
    70: "gnu general public license version 3 29 june 2007",
    71: "gnu general public license version 2 june 1991",
    72: "gnu lesser general public license version 3 29 june 2007",
    73: "gnu affero general public license version 3 19 november 2007",
    74: "gnu lesser general public license version 2 1 february 1999",
    75: "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    76: "the gnu general public license is a free copyleft license for software and other kinds of works",
    77: "the licenses for most software and other practical works are designed to take away your freedom to share and change the works",
    78: "the licenses for most software are designed to take away your freedom to share and change it",
    80: "this is free and unencumbered software released into the public domain",
    81: "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    82: "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
    83: "this software is provided as is without any express or implied warranty",
    84: "in no event will the authors be held liable for any damages arising from the use of this software",
    85: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    86: "the origin of this software must not be misrepresented",
    87: "you must not claim that you wrote the original software",
    88: "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    89: "this notice may not be removed or altered from any source distribution",
    90: "boost software license version 1 0 august 17th 2003",
    91: "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    92: "distributed under the boost software license version 1 0",
    93: "do what the fuck you want to public license",
    94: "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    96: "eclipse public license v 2 0",
    97: "the accompanying program is provided under the terms of this eclipse public license agreement",
    98: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    100: "apache license version 2 0 january 2004",
    101: "terms and conditions for use reproduction and distribution",
    102: "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
    103: "licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license",
    104: "legal entity shall mean the union of the acting entity and all other entities that control are controlled by or are under common control with that entity",
    105: "you or your shall mean an individual or legal entity exercising permissions granted by this license",
    106: "source form shall mean the preferred form for making modifications including but not limited to software source code documentation source and configuration files",
    107: "object form shall mean any form resulting from mechanical transformation or translation of a source form including but not limited to compiled object code generated documentation and conversions to other media types",
    108: "work shall mean the work of authorship whether in source or object form made available under the license as indicated by a copyright notice that is included in or attached to the work an example is provided in the appendix below",
    109: "derivative works shall mean any work whether in source or object form that is based on or derived from the work and for which the editorial revisions annotations elaborations or other modifications represent as a whole an original work of authorship",
    110: "contributor shall mean licensor and any individual or legal entity on behalf of whom a contribution has been received by licensor and subsequently incorporated within the work",
    111: "grant of copyright license",
    112: "grant of patent license",
    113: "a you must give any other recipients of the work or derivative works a copy of this license",
    114: "b you must cause any modified files to carry prominent notices stating that you changed the files",
    115: "unless required by applicable law or agreed to in writing licensor provides the work and each contributor provides its contributions on an as is basis without warranties or conditions of any kind either express or implied including without limitation any warranties or conditions of title non infringement merchantability or fitness for a particular purpose",
    116: "this license does not grant permission to use the trade names trademarks service marks or product names of the licensor except as required for reasonable and customary use in describing the origin of the work and reproducing the content of the notice file",
    117: "end of terms and conditions",
    120: "licensed under cc by nd 4 0",
    121: "licensed under cc by nc sa 4 0",
    122: "licensed under cc by nc nd 4 0",
    123: "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    124: "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    125: "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
    130: "licensed under the bsd 3 clause license",
    131: "licensed under the bsd 2 clause license",
    132: "licensed under the isc license",
    133: "licensed under the mozilla public license 2 0",
    134: "licensed under the gnu general public license version 3",
    135: "licensed under the gnu general public license version 2",
    136: "licensed under the gnu lesser general public license version 3",
    137: "licensed under the gnu lesser general public license version 2 1",
    138: "licensed under the gnu affero general public license version 3",
    139: "licensed under the eclipse public license 2 0",
    140: "released under the apache license version 2 0",
    141: "released under the bsd 3 clause license",
    142: "released under the bsd 2 clause license",
    143: "released under the gnu general public license version 3",
    144: "released under the gnu general public license version 2",
    145: "licensed under the zlib license",
    146: "licensed under the unlicense",
}
# Rules as (rule, licence, identifiers in order).
RULES = [
    ("apache-line", "Apache-2.0", (1,)),
    ("apache-notice", "Apache-2.0", (2, 3, 4, 5)),
    ("apache-notice-short", "Apache-2.0", (2, 3)),
    ("mit-line", "MIT", (10,)),
    ("mit-line-licensed", "MIT", (11,)),
    ("mit-text", "MIT", (13, 14, 15)),
    ("mit-titled-text", "MIT", (12, 13, 14, 15)),
    ("gpl3-line", "GPL-3.0-only", (20,)),
    ("gpl2-line", "GPL-2.0-only", (21,)),
    ("gpl3-notice", "GPL-3.0-or-later", (22, 24)),
    ("gpl2-notice", "GPL-2.0-or-later", (23, 24)),
    ("cc-by-nc-line", "CC-BY-NC-4.0", (30,)),
    ("cc-by-line", "CC-BY-4.0", (31,)),
    ("cc-by-sa-line", "CC-BY-SA-4.0", (32,)),
    ("cc-by-text", "CC-BY-4.0", (33,)),
    ("cc-by-nc-text", "CC-BY-NC-4.0", (34,)),
    ("cc-by-sa-text", "CC-BY-SA-4.0", (35,)),
    ("bsd3-text", "BSD-3-Clause", (40, 41, 42, 43)),
    ("bsd2-text", "BSD-2-Clause", (40, 41, 42)),
    ("isc-text", "ISC", (50,)),
    ("mpl2-notice", "MPL-2.0", (60,)),
    ("mit0-text", "MIT-0", (17, 15)),
    ("lgpl21-notice", "LGPL-2.1-or-later", (26, 29)),
    ("lgpl3-notice", "LGPL-3.0-or-later", (27, 24)),
    ("agpl3-notice", "AGPL-3.0-or-later", (28, 24)),
    ("cc0-line", "CC0-1.0", (36,)),
    ("cc0-notice", "CC0-1.0", (37,)),
    ("bsd3-university-text", "BSD-3-Clause", (40, 41, 42, 48)),
    ("bsd4-university-text", "BSD-4-Clause-UC", (40, 41, 42, 47, 48)),
    ("0bsd-text", "0BSD", (49, 51)),
    ("mpl2-title", "MPL-2.0", (63,)),
    ("mpl2-incompatible-notice", "MPL-2.0-no-copyleft-exception", (64,)),
    ("gpl3-text", "GPL-3.0-only", (70, 75)),
    ("gpl2-text", "GPL-2.0-only", (71, 75)),
    ("lgpl3-text", "LGPL-3.0-only", (72, 75)),
    ("agpl3-text", "AGPL-3.0-only", (73, 75)),
    ("lgpl21-text", "LGPL-2.1-only", (74, 75)),
    ("unlicense-text", "Unlicense", (80, 81)),
    ("zlib-text", "Zlib", (83, 84, 85)),
    ("boost-text", "BSL-1.0", (90, 91)),
    ("boost-line", "BSL-1.0", (92,)),
    ("wtfpl-text", "WTFPL", (93, 94)),
    ("epl2-text", "EPL-2.0", (96, 97)),
    ("epl2-notice", "EPL-2.0", (98,)),
    ("apache-text", "Apache-2.0", (100, 101, 102, 103)),
    ("cc-by-nd-line", "CC-BY-ND-4.0", (120,)),
    ("cc-by-nc-sa-line", "CC-BY-NC-SA-4.0", (121,)),
    ("cc-by-nc-nd-line", "CC-BY-NC-ND-4.0", (122,)),
    ("cc-by-nd-text", "CC-BY-ND-4.0", (123,)),
    ("cc-by-nc-sa-text", "CC-BY-NC-SA-4.0", (124,)),
    ("cc-by-nc-nd-text", "CC-BY-NC-ND-4.0", (125,)),
    ("bsd3-line", "BSD-3-Clause", (130,)),
    ("bsd2-line", "BSD-2-Clause", (131,)),
    ("isc-line", "ISC", (132,)),
    ("mpl2-line", "MPL-2.0", (133,)),
    ("gpl3-line-licensed", "GPL-3.0-only", (134,)),
    ("gpl2-line-licensed", "GPL-2.0-only", (135,)),
    ("lgpl3-line", "LGPL-3.0-only", (136,)),
    ("lgpl21-line", "LGPL-2.1-only", (137,)),
    ("agpl3-line", "AGPL-3.0-only", (138,)),
    ("epl2-line", "EPL-2.0", (139,)),
    ("apache-line-released", "Apache-2.0", (140,)),
    ("bsd3-line-released", "BSD-3-Clause", (141,)),
    ("bsd2-line-released", "BSD-2-Clause", (142,)),
    ("gpl3-line-released", "GPL-3.0-only", (143,)),
    ("gpl2-line-released", "GPL-2.0-only", (144,)),
    ("zlib-line", "Zlib", (145,)),
    ("unlicense-line", "Unlicense", (146,)),
]
# Where real notices have a stop inside a known sentence: behind these words of it.
STOPS_BEHIND = {
    22: ("is free software", "software foundation"),
    23: ("is free software", "software foundation"),
    24: ("any warranty",),
    26: ("is free software", "software foundation"),
    27: ("is free software", "software foundation"),
    28: ("is free software", "software foundation"),
    29: ("any warranty",),
    60: ("license v",),
    64: ("license v",),
}
# Every known sentence holds one of these, so texts without any of them have no known sentence.
MARKS = ("license", "licensed", "permission", "copyright", "distribut", "warrant", "liab", "conditions", "source", "entity", "object", "contribut", "modified", "advertising", "public", "original", "origin")


_END = "\x01"


def _add_tags() -> None:
    """A sentence and a rule for the line "SPDX-License-Identifier: X" of each licence in the rules."""
    for n, licence in enumerate(sorted({r[1] for r in RULES}), start=1000):
        SENTENCES[n] = "spdx license identifier " + licence.lower().replace("-", " ").replace(".", " ")
        STOPS_BEHIND[n] = ("license identifier",)
        RULES.append((f"tag-{licence}", licence, (n,)))


_add_tags()


def normalised(text: Column) -> Column:
    """A text's words in lower case, with a blank, a line feed (one line end) or ``_END`` (a stop, or lines without a word) between them.

    It starts and ends with ``_END``. All patterns take time in proportion to the text, however long its runs of marks are.
    """
    found = F.translate(F.lower(text), _END, "-")
    found = F.regexp_replace(found, r"(?<![.!?;:])[.!?;:]++(?:[\x20\x09-\x0D]|\z)", _END)
    found = F.regexp_replace(found, rf"[^\p{{L}}\p{{N}}\n{_END}]+", " ")
    found = F.regexp_replace(found, r" ?\n ?", "\n")
    found = F.regexp_replace(F.concat(F.lit(_END), found, F.lit(_END)), r"\n{2,}", _END)
    return F.regexp_replace(found, rf"[ \n]?{_END}[ \n{_END}]*", _END)


def _ways(known: dict[int, str], stops: dict[int, tuple[str, ...]], blank: str, stop: str) -> str:
    """Any of the known sentences, the longest first, with ``blank`` between words and ``stop`` where a stop may be too."""
    ways = []
    for n, sentence in known.items():
        for words in stops.get(n, ()):
            sentence = sentence.replace(words + " ", words + _END)
        ways.append(sentence.replace(" ", blank).replace(_END, stop))
    return "|".join(sorted(ways, key=len, reverse=True))


def _pattern(known: dict[int, str], stops: dict[int, tuple[str, ...]]) -> str:
    """A known sentence from one line end or stop to another; lines may be wrapped at any blank."""
    ways = _ways(known, stops, r"[ \n]", rf"[ \n{_END}]")
    return rf"(?<=[\n{_END}])(?:{ways})(?=[\n{_END}])"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[int, str] = SENTENCES, rules: list = RULES, marks: tuple[str, ...] = MARKS, stops: dict[int, tuple[str, ...]] = STOPS_BEHIND) -> DataFrame:
    """(doc_id, rule, licence, sentence_ids), a row for each rule that a text meets.

    A rule is met where its identifiers follow each other in the sequence of known sentences (unknown ones between them do
    not count); a rule whose place lies inside that of a longer rule that is met as well gives no row. A text with known
    sentences that meets no rule gives one row with null rule and licence. Null and empty texts, and texts without a
    known sentence, give none; repeated rows give repeated results, an empty table gives an empty result, and only the id and
    the text are read, whatever other columns are called. A known sentence may be wrapped over lines, and has
    stops inside only where ``stops`` allows them.
    """
    missing = [s for s in known.values() if not any(m in s for m in marks)]
    if missing:
        raise ValueError(f"no mark in: {missing[0]}")
    text, lower = F.col(text_col), F.lower(F.col(text_col))
    has_mark = F.lit(False)
    for m in marks:
        has_mark = has_mark | F.contains(lower, F.lit(m))
    ids = F.create_map(*[F.lit(x) for n, s in known.items() for x in (s, n)])
    matches = F.regexp_extract_all(normalised(text), F.lit(_pattern(known, stops)), F.lit(0))
    found = F.transform(matches, lambda s: F.try_element_at(ids, F.translate(s, "\n" + _END, "  ")))
    rows = docs.where(has_mark).select(F.col(id_col).alias("doc_id"), found.alias("sentence_ids")).where(F.size("sentence_ids") > 0)
    key = lambda seq: "," + ",".join(map(str, seq)) + ","
    joined = F.concat(F.lit(","), F.concat_ws(",,", F.col("sentence_ids").cast("array<string>")), F.lit(","))
    met = []
    for rule, licence, seq in rules:
        mine = "".join(key([n]) for n in seq)
        rest = joined
        for _, _, longer in sorted(rules, key=lambda r: -len(r[2])):
            if len(longer) > len(seq) and any(longer[i : i + len(seq)] == seq for i in range(len(longer))):
                rest = F.replace(rest, F.lit("".join(key([n]) for n in longer)), F.lit("|"))
        met.append(F.when(F.contains(rest, F.lit(mine)), F.struct(F.lit(rule).alias("rule"), F.lit(licence).alias("licence"))))
    rows = rows.withColumn("_met", F.filter(F.array(*met), lambda x: x.isNotNull()))
    return rows.select("doc_id", F.explode_outer("_met").alias("_m"), "sentence_ids").select("doc_id", "_m.rule", "_m.licence", "sentence_ids")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "rule", "licence", F.concat_ws(" ", F.col("sentence_ids").cast("array<string>")).alias("sentence_ids"))


def op6_sql() -> str:
    known = list(SENTENCES.items())
    texts = ", ".join(f"'{s}'" for _, s in known)
    numbers = ", ".join(str(n) for n, _ in known)
    key = lambda seq: "".join(f",{n}," for n in seq)
    cases = []
    for rule, licence, seq in RULES:
        rest = "joined"
        for _, _, longer in sorted(RULES, key=lambda r: -len(r[2])):
            if len(longer) > len(seq) and any(longer[i : i + len(seq)] == seq for i in range(len(longer))):
                rest = f"replace({rest}, '{key(longer)}', '|')"
        cases.append(f"SELECT doc_id, '{rule}' AS rule, '{licence}' AS licence, ids FROM seqs WHERE contains({rest}, '{key(seq)}')")
    union = " UNION ALL ".join(cases)
    steps = (("[.!?;:]+([\\x20\\x09-\\x0D]|\\z)", "chr(1)"), ("[^\\p{L}\\p{N}\\n\\x01]+", "' '"), (" ?\\n ?", "chr(10)"), ("\\n{2,}", "chr(1)"), ("[ \\n]?\\x01[ \\n\\x01]*", "chr(1)"))
    text = "translate(lower(text), chr(1), '-')"
    for i, (pattern, by) in enumerate(steps):
        text = f"regexp_replace({f'chr(1) || {text} || chr(1)' if i == 3 else text}, '{pattern}', {by}, 'g')"
    # line ends and stops are doubled, as a match takes one on either side
    text = f"replace(replace({text}, chr(10), chr(10) || chr(10)), chr(1), chr(1) || chr(1))"
    ways = _ways(SENTENCES, STOPS_BEHIND, "(?: |\\n\\n)", "(?: |\\n\\n|\\x01\\x01)")
    return f"""
WITH cut AS MATERIALIZED (
  SELECT doc_id, list_transform(regexp_extract_all({text}, '[\\n\\x01]({ways})[\\n\\x01]', 1),
    lambda s: ([{numbers}])[list_position([{texts}], replace(replace(s, chr(10) || chr(10), ' '), chr(1) || chr(1), ' '))]) AS ids
  FROM documents WHERE text IS NOT NULL),
seqs AS MATERIALIZED (SELECT doc_id, ids, ',' || array_to_string(ids, ',,') || ',' AS joined FROM cut WHERE len(ids) > 0),
met AS ({union})
SELECT doc_id, rule, licence, array_to_string(ids, ' ') AS sentence_ids FROM met
UNION ALL
SELECT doc_id, NULL, NULL, array_to_string(ids, ' ') FROM seqs WHERE doc_id NOT IN (SELECT doc_id FROM met)
"""
