"""Whole licence texts, whose digests ``tallyframe.llm.license_store`` holds."""

from __future__ import annotations

from pathlib import Path

FOLDER = Path("/usr/share/common-licenses")
NAMES = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3",
    "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
END = "END OF TERMS AND CONDITIONS"


def bsd_texts(regents: str) -> list[tuple[str, str]]:
    """The BSD text of the Regents without their notice, those with other owners, and those of two clauses."""
    body = regents[regents.index("Redistribution and use") :]
    found = [("BSD-3-Clause", body)]
    for owner in ("HOLDER", "OWNER"):
        own = body.replace("REGENTS AND", "COPYRIGHT HOLDERS AND").replace("REGENTS OR", f"COPYRIGHT {owner} OR").replace("the University nor", "the copyright holder nor")
        first, last = own.index("3. Neither"), own.index("THIS SOFTWARE")
        found += [("BSD-3-Clause", own), ("BSD-2-Clause", own[:first] + "\n" + own[last:])]
    return found + [(name, f"{name.replace('-', ' ', 1)} License\n\n{text}") for name, text in found]


def common_licences() -> list[tuple[str, str]]:
    """Each text as a whole, and as far as its terms where instructions follow them."""
    found = []
    for file, name in NAMES.items():
        text = (FOLDER / file).read_text("utf-8")
        found.append((name, text))
        if file == "BSD":
            found += bsd_texts(text)
        if END in text:
            terms = text[: text.index(END)]
            found += [(name, terms), (name, terms + END)]
    return found
