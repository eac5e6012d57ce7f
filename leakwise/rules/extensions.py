"""Extension tables: which files are text, which are confidential.

The defaults are the common kinds. Tables over some 200 entries are parameters: :func:`read_table` reads a CSV of extension
and description, and ``ExtensionTables.with_files`` takes a folder of them.
Extensions are compared with their case and include the dot.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass, field, replace
from pathlib import Path

# ---- Fixed values. ----
TEXT = (
    ".ada .adb .adoc .ads .am .ash .asm .asmx .asp .aspx .atom .awk .bat .bcc .bib .c .c# .c++ .c-- .cbl .cc .cmake .cob .conf .config .cp .cpp "
    ".cs .cshtml .css .csv .cxx .d .dart .diff .dml .do .dpr .dtd .el .eml .erb .erl .ex .f .f90 .f95 .for .fs .fsx .ftl .gemspec .go .gradle "
    ".groovy .gsp .h .h++ .haml .hbs .hc .hh .hpp .hs .htm .html .hxx .in .inc .jad .java .jl .js .json .jsp .jspf .jspx .kt .less .lhs .lisp "
    ".log .lsp .lst .lua .m .m4 .mak .make .md .mjs .mk .ml .mm .nfo .nim .out .pas .patch .php .php2 .pl .pli .pm .po .pod .pot .proto .ps1 "
    ".psd1 .psm1 .py .pyt .r .rb .resx .rkt .rs .rss .rst .rtf .ru .s .sass .scala .scm .scss .sed .sgml .sh .sol .sql .ss .strings .swift .t "
    ".tcl .tex .tpl .ts .tsv .twig .txt .v .vb .vba .vbs .vcf .vhd .vm .wsdl .xhtml .xml .xsd .xsl .xslt .yaml .yml "
).split()
DANGEROUS_NAMES = {"id_rsa": "SSH private key", "id_dsa": "SSH private key", "keystore": "Java key store"}
CERTIFICATES = {
    ".pem": "Certificate file", ".crt": "Certificate file", ".cer": "Certificate file", ".der": "Certificate file", ".p7b": "Certificate file",
    ".p7r": "Certificate file", ".spc": "Certificate file", ".pfx": "Certificate file", ".p12": "Certificate file", ".jks": "Java key store",
    ".ks": "Java key store", ".keystore": "Java key store", ".jceks": "Java key store", ".ubr": "Java key store", ".bks": "Java key store",
    ".sst": "Microsoft certificate store", ".sto": "Microsoft certificate store",
}
FINANCIAL = {
    ".iif": "QuickBooks interchange format", ".mny": "Microsoft Money data", ".ofx": "Open Financial Exchange format", ".qbw": "QuickBooks company data",
    ".qdf": "Quicken financial data", ".qfx": "Quicken Financial Exchange format", ".qif": "Quicken Interchange Format", ".tax": "TurboTax tax return",
}
DANGEROUS = {
    ".aes": "AES Crypt encrypted data", ".agilekeychain": "1Password data", ".asc": "PGP (Pretty Good Privacy) signature",
    ".enc": "Uuencode encoded data or BlackIce PC Protection evidence log or CopySafe PDF encrypted document or Media Safe encrypted data",
    ".fve": "Windows BitLocker full volume encrypted data", ".gpg": "GNU Privacy Guard public keyring", ".kdb": "KeePass encrypted passwords database",
    ".kdbx": "KeePass password database", ".key": "Licence or encrypted security key", ".keychain": "Apple Keychain password data",
    ".p12": "PFX file (Personal Information Exchange)", ".pgp": "Pretty Good Privacy encrypted key",
}
#: Always scanned, however large.
RECOGNISED = (".java", ".scala", ".kt", ".go", ".c", ".cpp", ".cc", ".c++", ".h++", ".hh", ".hpp", ".xml", ".json", ".yaml", ".yml", ".rb", ".erb", ".conf")
PRUNED_FOLDERS = (
    ".git", ".hg", ".svn", "node_modules", "vendor", ".venv", "venv", "__pycache__", "target", "build", "dist", ".gradle", ".terraform",
    ".next", ".nuxt", ".cache", ".idea", ".vscode",
)
SIZE_LIMIT = 10_240_000
SNIFFED_BYTES = 512
#: Names of the two finders that report files rather than values.
CONFIDENTIAL_PROVIDER, PATH_PROVIDER = "ConfidentialFiles", "PathBasedSecretsFinder"
# ---- End of the fixed values. ----


@dataclass(frozen=True)
class ExtensionTables:
    text: frozenset[str] = frozenset(TEXT)
    names: dict[str, str] = field(default_factory=lambda: dict(DANGEROUS_NAMES))
    certificates: dict[str, str] = field(default_factory=lambda: dict(CERTIFICATES))
    dangerous: dict[str, str] = field(default_factory=lambda: dict(DANGEROUS))
    financial: dict[str, str] = field(default_factory=lambda: dict(FINANCIAL))

    def with_files(self, folder: str | Path) -> ExtensionTables:
        """Tables replaced by ``text.csv``, ``certificates.csv``, ``dangerous.csv``, ``financial.csv`` where they exist."""
        found = {p.stem: read_table(p) for p in sorted(Path(folder).glob("*.csv"))}
        if "text" in found:
            found["text"] = frozenset(found["text"])
        return replace(self, **{k: v for k, v in found.items() if k in self.__dataclass_fields__})


def read_table(path: str | Path) -> dict[str, str]:
    """extension -> description; an extension given twice joins its descriptions by " or "."""
    out: dict[str, str] = {}
    with open(path, newline="", encoding="utf-8") as f:
        for row in csv.reader(f):
            if row and row[0].startswith("."):
                what = row[1] if len(row) > 1 else ""
                out[row[0]] = f"{out[row[0]]} or {what}" if row[0] in out and out[row[0]] != what else what
    return out
