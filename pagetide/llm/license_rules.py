"""Licence signatures: a table of families, spelled out per form of mention.

Each family gives an SPDX identifier, the address of its text, and the ways in
which its name is written, each with the rarest literals that all its matches
hold. ``rules()`` expands them by the ways in which texts state a licence; the
order of ``FORMS`` is the order of trust.

Literals are looked up in lower case with each run of white space and hyphens as
one blank (``keyword_form``).
"""

from __future__ import annotations

import re
from typing import NamedTuple

OSI = r"opensource\.org/licenses?/"
VERSION = r",? ?(?:Version |v\.?|-)?"
VERSION_DASH = r",?[ -]?(?:Version |v\.? ?)?"

# fixed values: SPDX identifier | literals and regex of its address | literals and regex of each name
FAMILIES = [
    ("MIT", ("opensource.org", "/mit"), OSI + r"MIT\b", [(("mit",), r"MIT(?:[- ]style)?")]),
    ("MIT-0", ("opensource.org", "/mit 0"), OSI + "MIT-0", [(("mit no attribution",), "MIT No Attribution"), (("mit 0",), "MIT-0")]),
    ("ISC", ("opensource.org", "/isc"), OSI + "ISC", [(("isc",), "ISC")]),
    ("Apache-1.1", ("apache.org", "license 1.1"), r"apache\.org/licenses/LICENSE-1\.1", [
        (("apache", "1.1", "license"), r"Apache(?: Software)? License,? (?:Version |v)?1\.1"), (("apache 1.1",), r"Apache-1\.1")]),
    ("Apache-2.0", ("apache.org", "license 2.0"), r"apache\.org/licenses/LICENSE-2\.0", [
        (("apache", "2"), r"Apache(?: Software)?(?: License)?,? (?:Version |v\.?)?2(?:\.0)?"), (("apache 2.0",), r"Apache-2\.0")]),
    ("BSD-2-Clause", ("opensource.org", "bsd 2 clause"), OSI + "BSD-2-Clause", [
        (("simplified bsd",), "Simplified BSD"), (("freebsd bsd",), "FreeBSD BSD"), (("2 clause bsd",), "2[- ]Clause BSD"), (("bsd 2 clause",), "BSD[- ]2[- ]Clause")]),
    ("BSD-3-Clause", ("opensource.org", "bsd 3 clause"), OSI + "BSD-3-Clause", [
        (("new bsd",), "New BSD"), (("modified bsd",), "Modified BSD"), (("revised bsd",), "Revised BSD"), (("3 clause bsd",), "3[- ]Clause BSD"),
        (("bsd 3 clause",), "BSD[- ]3[- ]Clause")]),
    ("BSD-4-Clause", ("opensource.org", "bsd 4 clause"), OSI + "BSD-4-Clause", [
        (("original bsd",), "Original BSD"), (("4 clause bsd",), "4[- ]Clause BSD"), (("bsd 4 clause",), "BSD[- ]4[- ]Clause")]),
    ("0BSD", ("opensource.org", "/0bsd"), OSI + "0BSD", [
        (("zero clause bsd",), "Zero[- ]Clause BSD"), (("clause bsd",), "0[- ]?Clause BSD"), (("0bsd",), "0BSD"), (("bsd zero clause",), "BSD Zero Clause")]),
    ("GPL-1.0", ("gnu.org", "gpl 1.0"), r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0", [
        (("gpl", "1"), rf"(?:GNU )?GPL{VERSION}1(?:\.0)?"), (("general public license", "1"), rf"(?:GNU )?General Public License{VERSION}1(?:\.0)?")]),
    ("GPL-2.0", ("gnu.org", "gpl 2.0"), r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0", [
        (("gpl", "2"), rf"(?:GNU )?GPL{VERSION}2(?:\.0)?"), (("general public license", "2"), rf"(?:GNU )?General Public License{VERSION}2(?:\.0)?")]),
    ("GPL-3.0", ("gnu.org", "gpl 3.0"), r"gnu\.org/licenses/gpl-3\.0", [
        (("gpl", "3"), rf"(?:GNU )?GPL{VERSION}3(?:\.0)?"), (("general public license", "3"), rf"(?:GNU )?General Public License{VERSION}3(?:\.0)?")]),
    ("LGPL-2.0", ("gnu.org", "lgpl 2.0"), r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0", [
        (("lgpl", "2"), rf"(?:GNU )?LGPL{VERSION}2(?:\.0)?"), (("library general public", "2"), rf"(?:GNU )?Library General Public License{VERSION}2(?:\.0)?")]),
    ("LGPL-2.1", ("gnu.org", "lgpl 2.1"), r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1", [
        (("lgpl", "2.1"), rf"(?:GNU )?LGPL{VERSION}2\.1"), (("lesser general public", "2.1"), rf"(?:GNU )?Lesser General Public License{VERSION}2\.1")]),
    ("LGPL-3.0", ("gnu.org", "lgpl 3.0"), r"gnu\.org/licenses/lgpl-3\.0", [
        (("lgpl", "3"), rf"(?:GNU )?LGPL{VERSION}3(?:\.0)?"), (("lesser general public", "3"), rf"(?:GNU )?Lesser General Public License{VERSION}3(?:\.0)?")]),
    ("AGPL-3.0", ("gnu.org", "agpl 3.0"), r"gnu\.org/licenses/agpl-3\.0", [
        (("agpl", "3"), rf"(?:GNU )?AGPL{VERSION}3(?:\.0)?"), (("affero general public", "3"), rf"(?:GNU )?Affero General Public License{VERSION}3(?:\.0)?")]),
    ("GFDL-1.2", ("gnu.org", "fdl 1.2"), r"gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2", [
        (("gfdl", "1.2"), r"GFDL[- ]?(?:v)?1\.2"), (("gnu fdl 1.2",), r"GNU FDL 1\.2")]),
    ("GFDL-1.3", ("gnu.org", "fdl 1.3"), r"gnu\.org/licenses/fdl-1\.3", [
        (("gfdl", "1.3"), r"GFDL[- ]?(?:v)?1\.3"), (("gnu fdl 1.3",), r"GNU FDL 1\.3")]),
    ("MPL-1.1", ("mozilla.org", "/mpl/1.1"), r"mozilla\.org/MPL/1\.1", [
        (("mozilla public license", "1.1"), rf"Mozilla Public License{VERSION_DASH}1\.1"), (("mpl", "1.1"), rf"MPL{VERSION_DASH}1\.1")]),
    ("MPL-2.0", ("mozilla.org", "mpl/2.0"), r"mozilla\.org/(?:en-US/)?MPL/2\.0", [
        (("mozilla public license", "2"), rf"Mozilla Public License{VERSION_DASH}2(?:\.0)?"), (("mpl", "2"), rf"MPL{VERSION_DASH}2(?:\.0)?")]),
    ("EPL-1.0", ("eclipse.org", "epl v10"), r"eclipse\.org/legal/epl-v10", [
        (("eclipse public license", "1"), rf"Eclipse Public License{VERSION_DASH}1(?:\.0)?"), (("epl", "1"), rf"EPL{VERSION_DASH}1(?:\.0)?")]),
    ("EPL-2.0", ("eclipse.org", "epl 2.0"), r"eclipse\.org/legal/epl-2\.0", [
        (("eclipse public license", "2"), rf"Eclipse Public License{VERSION_DASH}2(?:\.0)?"), (("epl", "2"), rf"EPL{VERSION_DASH}2(?:\.0)?")]),
    ("CDDL-1.0", ("opensource.org", "cddl 1.0"), OSI + r"CDDL-1\.0", [(("cddl", "1.0"), r"CDDL[- ]?1\.0"), (("cddl", "version 1.0"), r"CDDL,? Version 1\.0")]),
    ("CDDL-1.1", ("opensource.org", "cddl 1.1"), OSI + r"CDDL-1\.1", [(("cddl", "1.1"), r"CDDL[- ]?1\.1"), (("cddl", "version 1.1"), r"CDDL,? Version 1\.1")]),
    ("CPL-1.0", ("opensource.org", "cpl 1.0"), OSI + r"CPL-1\.0", [(("common public license", "1.0"), r"Common Public License,? ?(?:Version |v)?1\.0")]),
    ("EUPL-1.1", ("joinup.ec", "eupl1.1"), r"joinup\.ec\.europa\.eu/\S*eupl1\.1", [
        (("european union public licen", "1.1"), rf"European Union Public Licen[cs]e{VERSION_DASH}1\.1"), (("eupl", "1.1"), rf"EUPL{VERSION_DASH}1\.1")]),
    ("EUPL-1.2", ("joinup.ec", "eupl 1.2"), r"joinup\.ec\.europa\.eu/\S*eupl-1\.2", [
        (("european union public licen", "1.2"), rf"European Union Public Licen[cs]e{VERSION_DASH}1\.2"), (("eupl", "1.2"), rf"EUPL{VERSION_DASH}1\.2")]),
    ("Artistic-1.0", ("opensource.org", "artistic 1.0"), OSI + r"Artistic-1\.0", [
        (("artistic license", "1.0"), r"Artistic License,? ?(?:Version |v)?1\.0"), (("artistic 1.0",), r"Artistic-1\.0")]),
    ("Artistic-2.0", ("opensource.org", "artistic 2.0"), OSI + r"Artistic-2\.0", [
        (("artistic license", "2"), r"Artistic License,? ?(?:Version |v)?2(?:\.0)?"), (("artistic 2.0",), r"Artistic-2\.0")]),
    ("BSL-1.0", ("boost.org", "license_1_0"), r"boost\.org/LICENSE_1_0", [(("boost software license", "1.0"), r"Boost Software License,? ?(?:-|Version |v)? ?1\.0")]),
    ("BUSL-1.1", ("mariadb.com", "bsl11"), r"mariadb\.com/bsl11", [(("business source license", "1.1"), r"Business Source License,? ?(?:Version |v)?1\.1")]),
    ("Zlib", ("opensource.org", "/zlib"), OSI + "Zlib", [(("zlib",), r"zlib(?:/libpng)?")]),
    ("Unlicense", ("unlicense.org",), r"unlicense\.org", [(("unlicense",), "(?:The )?Unlicense")]),
    ("WTFPL", ("wtfpl.net",), r"wtfpl\.net", [(("wtfpl",), "WTFPL")]),
    ("OFL-1.1", ("scripts.sil", "/ofl"), r"scripts\.sil\.org/OFL", [
        (("sil open font license", "1.1"), r"SIL Open Font License,? ?(?:Version |v)?1\.1"), (("ofl", "1.1"), r"OFL[- ]?1\.1")]),
    ("PSF-2.0", ("docs.python", "license"), r"docs\.python\.org/\S*license", [
        (("python software foundation license",), "Python Software Foundation License"), (("psf license",), "PSF License"), (("psf 2.0",), r"PSF-2\.0")]),
    ("PostgreSQL", ("opensource.org", "/postgresql"), OSI + "PostgreSQL", [(("postgresql",), "PostgreSQL")]),
    ("NCSA", ("opensource.org", "/ncsa"), OSI + "NCSA", [(("illinois/ncsa",), "University of Illinois/NCSA(?: Open Source)?"), (("ncsa",), "NCSA")]),
    ("MS-PL", ("opensource.org", "/ms pl"), OSI + "MS-PL", [(("microsoft public license",), "Microsoft Public License"), (("ms pl",), "Ms-PL")]),
    ("MS-RL", ("opensource.org", "/ms rl"), OSI + "MS-RL", [(("microsoft reciprocal license",), "Microsoft Reciprocal License"), (("ms rl",), "Ms-RL")]),
    ("SSPL-1.0", ("mongodb.com", "server side public license"), r"mongodb\.com/licensing/server-side-public-license", [
        (("server side public license", "1"), r"Server Side Public License,? ?(?:Version |v)?1"), (("sspl", "1"), r"SSPL[- ]?(?:v)?1(?:\.0)?")]),
    ("ODbL-1.0", ("opendatacommons", "odbl"), r"opendatacommons\.org/licenses/odbl", [
        (("database license",), r"Open (?:Data Commons Open )?Database License(?: v?1\.0)?"), (("odbl",), r"ODbL(?:[- ]1\.0)?")]),
    ("ODC-BY-1.0", ("opendatacommons", "/by"), r"opendatacommons\.org/licenses/by", [
        (("open data commons attribution license",), r"Open Data Commons Attribution License(?: v?1\.0)?"), (("odc by",), r"ODC-BY(?:-1\.0)?")]),
    ("PDDL-1.0", ("opendatacommons", "pddl"), r"opendatacommons\.org/licenses/pddl", [
        (("public domain dedication and license",), "Public Domain Dedication and License"), (("pddl",), r"PDDL(?:-1\.0)?")]),
    ("OGL-UK-3.0", ("nationalarchives", "open government licence"), r"nationalarchives\.gov\.uk/doc/open-government-licence", [
        (("open government licen",), r"Open Government Licen[cs]e(?: v?3(?:\.0)?)?")]),
    ("CC0-1.0", ("creativecommons", "/zero/1.0"), r"creativecommons\.org/publicdomain/zero/1\.0", [
        (("cc0",), r"CC0(?:[- ]1\.0)?"), (("creative commons zero",), "Creative Commons Zero")]),
]

# fixed values: Creative Commons elements, their words (with a literal), and versions
CC_PARTS = [
    ("BY", "attribution", r"Attribution"),
    ("BY-SA", "alike", r"Attribution[- ]Share ?Alike"),
    ("BY-ND", "deriv", r"Attribution[- ]No ?Deriv(?:ative)?s?"),
    ("BY-NC", "commercial", r"Attribution[- ]Non ?Commercial"),
    ("BY-NC-SA", "alike", r"Attribution[- ]Non ?Commercial[- ]Share ?Alike"),
    ("BY-NC-ND", "deriv", r"Attribution[- ]Non ?Commercial[- ]No ?Deriv(?:ative)?s?"),
]
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]

# fixed values: statements without a family
STATEMENTS = [
    ("proprietary", 40, ("reserved",), r"\ball rights (?:are )?reserved\b"),
    ("proprietary", 55, ("proprietary and confidential",), r"\bproprietary and confidential\b"),
    ("proprietary", 50, ("may not be copied",), r"\bmay not be copied\b"),
    ("proprietary", 50, ("may not be reproduced",), r"\bmay not be reproduced\b"),
    ("proprietary", 50, ("may not be redistributed",), r"\bmay not be redistributed\b"),
    ("public-domain", 50, ("public domain", "released"), r"\breleased (?:in)?to the public domain\b"),
    ("public-domain", 50, ("public domain", "dedicated"), r"\bdedicated (?:in)?to the public domain\b"),
    ("public-domain", 50, ("public domain", "placed"), r"\bplaced (?:in)?to the public domain\b"),
    ("public-domain", 45, ("in the public domain",), r"\bin the public domain\b"),
    ("copyright", 20, ("copyright",), r"\bcopyright (?:\(c\)|©|[0-9]{4})"),
    ("copyright", 20, ("(c)",), r"\(c\) (?:19|20)[0-9]{2}\b"),
    ("warranty-disclaimer", 30, ("provided", "as is"), r"\bprovided [\"']?as is[\"']?"),
    ("warranty-disclaimer", 30, ("provided", "as is"), r"\bprovided [\"']?as-is[\"']?"),
    ("MIT", 75, ("permission is hereby granted",), r"\bpermission is hereby granted, free of charge\b"),
    ("ISC", 75, ("permission to use",), r"\bpermission to use, copy, modify,? and(?:/or)? distribute this software\b"),
    ("BSD", 70, ("redistribution and use",), r"\bredistribution and use in source and binary forms\b"),
    ("GPL", 35, ("general public licen",), r"\bgeneral public licen[cs]e\b"),
    ("LGPL", 38, ("lesser general public licen",), r"\blesser general public licen[cs]e\b"),
    ("LGPL", 38, ("library general public licen",), r"\blibrary general public licen[cs]e\b"),
    ("AGPL", 38, ("affero general public licen",), r"\baffero general public licen[cs]e\b"),
    ("CC", 35, ("creative commons",), r"\bcreative commons\b"),
]

LEAD = r"\b(?:licen[cs]ed|released|distributed|available|published|redistributed)"
LEAD_MARK = "\x00lead"  # stands in the keyword text where a lead and "under" occur

#: (trust, literals of the form, regex around the name)
FORMS = [
    (90, (LEAD_MARK,), rf"{LEAD} under (?:the )?(?:terms of )?(?:the )?(?:{{name}})(?: licen[cs]e)?(?![\w-])"),
    (70, ("licen",), r"\b(?:{name}) licen[cs]e\b"),
    (60, ("licen",), r"\blicen[cs]e\s*[:=]\s*[\"']?(?:{name})(?![\w-])"),
]


def keyword_form(literal: str) -> str:
    """A literal as the keyword text spells it."""
    return re.sub(r"[\s-]+", " ", literal.lower())


def spaced(pattern: str) -> str:
    """``pattern`` with each blank standing for any white space: mentions wrap."""
    for a, b in (("[- ]", r"(?:-|\s+)"), ("[ -]", r"(?:-|\s+)"), (" ?", r"\s*"), (" ", r"\s+")):
        pattern = pattern.replace(a, b)
    return pattern


class Rule(NamedTuple):
    label: str
    priority: int
    keywords: tuple[str, ...]
    pattern: str


def rules() -> list[Rule]:
    """All rules in a fixed order; patterns ignore ASCII case."""
    families = list(FAMILIES)
    for part, word, words in CC_PARTS:
        for v in CC_VERSIONS:
            ver = v.replace(".", r"\.")
            families.append((
                f"CC-{part}-{v}", ("creativecommons", f"/{part.lower()}/{v}"), rf"creativecommons\.org/licenses/{part.lower()}/{ver}", [
                    ((f"cc {part.lower()}", v), rf"CC[- ]{part.replace('-', '[- ]')}[- ](?:v)?{ver}"),
                    (("creative commons attribution", word, v), rf"Creative Commons {words} {ver}"),
                    (("creative commons attribution", word, f"version {v}"), rf"Creative Commons {words},? [Vv]ersion {ver}"),
                ],
            ))
    out = []
    for label, where, url, names in families:
        spdx = label.replace(".", r"\.")
        out.append(Rule(label, 100, ("spdx", label), rf"SPDX-License-Identifier:\s*{spdx}(?:-only|-or-later)?(?![\w.-])"))
        out.append(Rule(label, 95, where, url))
        out += [Rule(label, trust, (*form, *literals), regex.format(name=name)) for trust, form, regex in FORMS for literals, name in names]
    out += [Rule(*s) for s in STATEMENTS]
    return [r._replace(pattern="(?i)" + spaced(r.pattern), keywords=tuple(dict.fromkeys(map(keyword_form, r.keywords)))) for r in out]


#: A text can match some rule only if one of these occurs in it (lower case), or a lead.
GATE_LITERALS = [
    "licen", "spdx", "opensource.org", "apache.org", "gnu.org", "mozilla.org", "eclipse.org", "joinup.ec", "boost.org", "mariadb.com", "wtfpl.net",
    "scripts.sil", "docs.python", "mongodb.com", "opendatacommons", "nationalarchives", "creativecommons", "reserved", "confidential",
    "redistribut", "copied", "reproduced", "domain", "copyright", "(c)", "provided", "permission", "creative",
]
LEAD_UNDER = rf"{LEAD}\s+under"
GATE = "(?i)" + "|".join(map(re.escape, GATE_LITERALS)) + "|" + LEAD_UNDER
