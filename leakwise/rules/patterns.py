"""The finders' patterns, for Python's ``re`` on text.

The dialect they come from is RE2: ``\\s`` and ``\\d`` there are ASCII classes, and a group can be switched to ungreedy,
which ``re`` can't, so the builders below take the greediness as an argument.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from pathlib import Path

WS = r"[\t\n\f\r ]"

# ---- Fixed values: the patterns, word lists and names that decide what is found. ----
NAME_CHAR = r"[a-zA-Z_$0-9-]"
QUOTE = "[\"'`]"
NOT_QUOTE = "[^'\"`]*"
MIN_LENGTH = 8
NAME_WORDS = ("secret", "private", "sensitive", "confidential", "c(?:y|i)pher", "crypt", "signature", "nonce", "credential", "cert", "key", "token", "salt")
COMMON = (r"password[0-9]?", "change(?:it|me)", "postgres", "admin", "root", "qwerty", "1234567?8?", "111111")
BASE64 = r"[a-zA-Z0-9+/]{0,8}[0-9][a-zA-Z0-9+/]{8,}={1,2}"
HEX = r"[0-9a-fA-F-]{16,}"
INDICATORS = "|".join((*COMMON, BASE64, HEX))
UNUSUAL_START = "<>&^%?#({|/"
CERTIFICATE = r"-----BEGIN ([^-]+)-----"

SECRET_ASSIGNMENT = "Hard-coded secret assignment"
NAME_IS_SECRET = "Variable name suggests it is a secret"
ENCODED = "Value looks suspiciously like an encoded secret (e.g. Base64 or Hex encoded)"
UNBROKEN = "Unbroken string may be a secret"
HARD_CODED = "Hard-coded secret"
COMMON_CREDENTIAL = "Value contains or appears to be a common credential"
SUSPICIOUS = "Value looks suspiciously like a secret"
HIGH_ENTROPY = "Value has a high entropy, may be a secret"
NOT_SECRET = "Value does not appear to be a secret"

GITHUB = "Discovered a GitHub OAuth Access Token, posing a risk of compromised GitHub account integrations and data leaks."
GITLAB = "Identified a GitLab Personal Access Token, risking unauthorized access to GitLab repositories and codebase exposure."
SLACK = "Identified a Slack Bot token, which may compromise bot integrations and communication channel security."
STRIPE = "Found a Stripe Access Token, posing a risk to payment processing services and sensitive financial data."
CONNECTION = "Connection URI Secret"
CONNECTORS = {
    "jdbc": "Database Server", "odbc": "Database Server", "s?ftp": "FTP Server", "https?": "HTTP Service", "tcp": "TCP Service", "urn": "",
    "oracle": "Oracle Database", "mongodb": "MongoDB Database", "postgres": "Postgres Database", "postgresql": "Postgres Database",
    "postgis": "Postgres GIS Database", "mysql": "MySQL Database", "mssql": "Microsoft SQL Database", "mariadb": "MariaDB Database",
    "amqp": "AMQP Message Queuing Protocol", "db2": "IBM DB2 Database",
}
VENDOR = {
    GITHUB: r"(?i:(gh[pousr]_[A-Za-z0-9_]{36,255}))",
    GITLAB: r"(?i:(glpat-[A-Za-z0-9\-]{20,255}))",
    SLACK: r"(?i:(xox[apbr]-2?[A-Za-z0-9-]{24,}))",
    "Python Package Index Token": r"(?i:(pypi-[A-Za-z0-9-=]{24,}))",
    "Terraform Cloud Token": r"(?i:([^\n]+[.]atlasv1[.][A-Za-z0-9-=]{24,}))",
    STRIPE: r"(?i:(?:sk_(?:live|test)|whsec)_[A-Za-z0-9-]{24,})",
    "GoCardless Token": r"(?i:(live_[A-Za-z0-9_-]{20,255}))",
    "FlutterWave/MoneyWave API Key": r"(?i:((flwseck-|ts_)[A-Za-z0-9_-]{20,}))",
    CONNECTION: rf"(?i:((?:{'|'.join(sorted(CONNECTORS))})[^:]*://[^:]+:[^@]+@))[^\n]*",
}
#: What the known findings show: these vendors' values are Critical, others High.
VENDOR_CRITICAL = (GITHUB, SLACK, "GoCardless Token")


def secret_name(lazy: bool = True) -> str:
    """The group of a variable whose name suggests a secret; ``lazy`` says how its free parts extend."""
    free, more, maybe = (("*?", "+", "?") if lazy else ("*", "+?", "??"))
    words = "|".join((*NAME_WORDS, f"auth(?:[^o]|o[^r]){more}", f"pass(?:[^e]|e[^ds]){more}(?:word|phrase){maybe}", f"ps{maybe}wd"))
    return f"({NAME_CHAR}{free}(?i:{words}){NAME_CHAR}{free})"


def quoted(lazy: bool = False) -> str:
    end = "*?" if lazy else "*"
    return "|".join(rf"(?s:{q}(?:[^{q}\\]|\\.){end}{q})" for q in "\"'`")


#: A name at the start of a pattern is tried where a run of name characters starts: what matches from inside the run
#: also matches from its start, so nothing is lost and long runs cost linear time.
RUN = f"(?<!{NAME_CHAR})"


@cache
def finder_patterns() -> dict[str, re.Pattern]:
    n, ng, q, qg = secret_name(), secret_name(False), quoted(), quoted(True)
    w, wl = WS + "*", WS + "*?"
    tail = r"[^\n]*?\n"
    text = {
        "assignment": rf"{RUN}{n}{w}(?::[^=]+)?{w}[+]?!?==?{w}({q})",
        "conf": rf"{RUN}{n}{w}[+]?!?=?{w}({q})",
        "cpp": rf"{RUN}{n}{w}[+]?!?==?{w}L?({q})",
        "define": rf"(?i:#define){WS}+{n}{w}L?({q})",
        "json_literal": rf'(?i:"{n}"{w}:{w}([0-9]+|true|false)[^\n]*\n)',
        "json_string": rf"{QUOTE}{wl}{ng}{wl}{QUOTE}{wl}:{wl}({qg}){tail}",
        "yaml": rf"{RUN}{QUOTE}??{wl}{ng}{wl}{QUOTE}??{wl}:{wl}({qg}|[^\n,]*?\n),??",
        "arrow_quoted": rf"{QUOTE}{wl}{ng}{wl}{QUOTE}{wl}=>{wl}({qg}|{tail})",
        "arrow_bare": rf"{RUN}{ng}{wl}=>{wl}({qg}|{tail})",
        "tags": rf"<{w}{n}{w}>([^<]*)<",
        "long_strings": rf"((?:{q}){{{MIN_LENGTH},}})",
        "secret_tag_values": rf">{w}((?i:{INDICATORS}[^<]*))<",
        "long_tag_values": rf">([^\t\n\f\r <]{{{MIN_LENGTH},}})<",
        "secret_unquoted": rf"{w}((?i:{INDICATORS}[^\t\n\f\r ]*)){w}",
        "secret_unquoted_plain": rf"{w}((?i:{'|'.join((*COMMON, HEX))}[^\t\n\f\r ]*)){w}",
        "long_unquoted": rf"([^\t\n\f\r ]{{{MIN_LENGTH},}}){w}",
    }
    return {k: re.compile(v) for k, v in text.items()}


# ---- End of the fixed values. ----


_QUOTES = re.compile(QUOTE)
_PLAIN_INDICATOR = re.compile("|".join((*COMMON, HEX)), re.I)
#: A run of base64 characters up to an equals sign. The indicator's own pattern would try every start of a run, which is
#: quadratic in a long one; it matches somewhere if and only if such a run has a digit with eight characters after it.
_BASE64_RUN = re.compile(r"(?<![a-zA-Z0-9+/])[a-zA-Z0-9+/]{9,}(?==)")


def has_base64(text: str) -> bool:
    return "=" in text and any(any(c in "0123456789" for c in m[0][:-8]) for m in _BASE64_RUN.finditer(text))


def has_indicator(text: str) -> bool:
    return bool(_PLAIN_INDICATOR.search(text)) or has_base64(text)


def quoted_indicators(text: str) -> Iterator[tuple[int, int]]:
    """Spans from a quote to the next one with an indicator between; a span that isn't one leaves its end as a start.

    This is the pattern ``quote not-quote* indicator not-quote* quote`` in linear time: no indicator holds a quote.
    """
    at = -1
    for m in _QUOTES.finditer(text):
        if at >= 0 and has_indicator(text[at + 1 : m.start()]):
            yield at, m.end()
            at = -1
        else:
            at = m.start()


def spans(key: str, text: str) -> Iterator[tuple[int, int]]:
    """Where the string pattern ``key`` matches."""
    if key == "secret_strings":
        return quoted_indicators(text)
    if key == "secret_unquoted" and not has_base64(text):
        key = "secret_unquoted_plain"
    return (m.span() for m in finder_patterns()[key].finditer(text))


#: Provider name of each pattern.
PROVIDERS = {
    "assignment": "SecretAssignment", "conf": "ConfSecretAssignment", "cpp": "CPPSecretAssignment", "define": "DefineSecretAssignment",
    "json_literal": "JSONSecretAssignment", "json_string": "JSONSecretAssignment", "yaml": "YAMLSecretAssignment",
    "arrow_quoted": "ArrowSecretAssignment", "arrow_bare": "ArrowSecretAssignment", "tags": "ElementSecretAssignment",
    "long_strings": "LongOrSuspiciousSecretString", "secret_strings": "SuspiciousOrCommonSecretString",
}
#: What a text must hold for an assignment pattern to match at all.
NEEDS = {"assignment": "=", "cpp": "=", "define": "#", "json_literal": ":", "json_string": ":", "yaml": ":", "arrow_quoted": "=>", "arrow_bare": "=>", "tags": "<"}
ASSIGNMENTS = {"assignment", "conf", "cpp", "define", "json_literal", "json_string", "yaml", "arrow_quoted", "arrow_bare", "tags"}
#: Pattern and provider of the rules for XML texts, in order.
XML_STRINGS = (
    ("assignment", "SecretAssignmentInXML"), ("yaml", "SecretAssignmentInXML"), ("arrow_bare", "SecretAssignmentInXML"),
    ("arrow_quoted", "SecretAssignmentInXML"), ("secret_unquoted", "SuspiciousOrCommonSecretInXML"),
    ("long_unquoted", "LongOrSuspiciousSecretInXML"), ("secret_strings", "SuspiciousOrCommonSecretString"),
    ("long_strings", "LongOrSuspiciousSecretString"),
)
#: Finders of each class of file, after the vendor rules. (The tag-value finders of the Ruby classes ask for two groups
#: and have one, so they never give a finding; they are left out.)
CLASSES = {
    "java": ("assignment", "secret_strings", "long_strings"),
    "cpp": ("cpp", "define", "secret_strings", "long_strings"),
    "xml": (),
    "yaml": ("yaml", "json_string", "secret_strings", "long_strings"),
    "ruby": ("tags", "assignment", "yaml", "secret_strings", "long_strings"),
    "eruby": ("tags", "assignment", "secret_strings", "long_strings", "json_literal", "yaml", "json_string"),
    "conf": ("conf", "assignment", "yaml", "json_literal", "json_string", "secret_strings", "long_strings"),
    "default": ("assignment", "secret_strings", "long_strings", "yaml", "arrow_quoted", "arrow_bare"),
}
CLASS_EXTENSIONS = {
    "java": (".java", ".scala", ".kt", ".go"),
    "cpp": (".c", ".cpp", ".cc", ".c++", ".h++", ".hh", ".hpp", ".hxx"),
    "xml": (".xml",),
    "yaml": (".yaml", ".yml", ".json"),
    "ruby": (".rb",),
    "eruby": (".erb",),
    "conf": (".conf",),
}


@dataclass(frozen=True)
class VendorRule:
    id: str
    pattern: str

    @property
    def regex(self) -> re.Pattern:
        return _compiled(self.pattern)

    @property
    def emits(self) -> bool:
        """Only rules with exactly one group give findings of their own; others only classify values."""
        return self.regex.groups == 1


@cache
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def portable(pattern: str) -> str:
    """An RE2 pattern in Python's dialect: POSIX classes, ASCII classes, end of text; inline flags go to the front."""
    out = pattern.replace("[[:alnum:]]", "[0-9A-Za-z]").replace("[:alnum:]", "0-9A-Za-z").replace(r"\z", r"\Z")
    flags = "".join(sorted(set("".join(re.findall(r"\(\?([imsx]+)\)", out)))))
    out = re.sub(r"\(\?[imsx]+\)", "", out)
    return f"(?{flags}:{out})" if flags else out


def load_rule_file(path: str | Path) -> dict[str, str]:
    """description -> pattern of a TOML file of ``[[rules]]`` with ``description`` and ``regex``.

    Later rules replace earlier ones of the same description; rules without a regex and patterns that don't compile
    are left out. All other fields are ignored.
    """
    with open(path, "rb") as f:
        rules = tomllib.load(f).get("rules", [])
    out: dict[str, str] = {}
    for rule in rules:
        pattern = portable(rule.get("regex", ""))
        try:
            ok = bool(pattern) and bool(_compiled(pattern))
        except re.error:
            ok = False
        if ok:
            out[rule.get("description", rule.get("id", ""))] = pattern
    return out


def vendor_rules(extra: dict[str, str] | None = None) -> tuple[VendorRule, ...]:
    """The built-in rules and ``extra`` ones (built-ins win on equal names), in the order in which they are tried."""
    return tuple(VendorRule(k, v) for k, v in sorted({**(extra or {}), **VENDOR}.items()))
