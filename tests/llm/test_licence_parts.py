"""Licence headers that begin alike and differ in their later parts."""

from veilspan.llm import license_rules

GPL2 = license_rules.SENTENCES["gpl2-later"]
HEAD = GPL2[: GPL2.index("either version 2")]


def test_later_parts_count(docs_of):
    warranty = license_rules.SENTENCES["gpl-warranty"]
    mpl = license_rules.SENTENCES["mpl2"]
    texts = {
        GPL2: "GPL-2.0-or-later",
        GPL2.replace(", or (at", ",\n * or (at").replace("This program", "Other words") + " " + warranty: "GPL-2.0-or-later",
        HEAD + "version 2 of the License.": "GPL-2.0-only",
        HEAD + "version 2\nof the License.\n\n" + warranty: "GPL-2.0-only",
        HEAD + "either version 3 of the License, or (at your option) any later version.": "",
        HEAD: "",
        mpl: "MPL-2.0",
        mpl.replace("2.0", "1.1"): "",
    }
    got = {r.doc_id: r.licenses for r in license_rules.licences(docs_of(*texts)).collect()}
    assert got == dict(enumerate(texts.values()))


def test_named_organisations_and_lesser_licences(docs_of):
    known = license_rules.SENTENCES
    bsd = "\n".join(known[n] for n in ("bsd-grant", "bsd-source", "bsd-binary"))
    clause = known["bsd-names"]
    lesser = known["lgpl21-later"]
    texts = {
        bsd + "\n * " + clause.replace("the copyright holder", "Acme, Inc."): "BSD-3-Clause",
        bsd + "\n3. " + clause.replace("the copyright holder", "the University of\n   Somewhere"): "BSD-3-Clause",
        bsd + "\nNeither the name of Acme is known.": "BSD-2-Clause",
        known["lgpl2-later"]: "LGPL-2.0-or-later",
        lesser.replace("This library", "Some words"): "LGPL-2.1-or-later",
        known["lgpl21-only"] + " " + known["gpl-warranty"]: "LGPL-2.1-only",
        known["lgpl3-later"]: "LGPL-3.0-or-later",
        known["agpl3-later"] + "\n\n" + known["gpl-warranty"]: "AGPL-3.0-or-later",
        "   Apache License\n  Version 2.0, January 2004\n http://www.apache.org/licenses/\n\n TERMS": "Apache-2.0",
        "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nCopyright": "GPL-3.0-only",
        "GNU LESSER GENERAL PUBLIC LICENSE\n   Version 2.1, February 1999\n": "LGPL-2.1-only",
        "GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007\n": "AGPL-3.0-only",
        "Mozilla Public License Version 2.0\n====": "MPL-2.0",
    }
    got = {r.doc_id: r.licenses for r in license_rules.licences(docs_of(*texts)).collect()}
    assert got == dict(enumerate(texts.values()))
