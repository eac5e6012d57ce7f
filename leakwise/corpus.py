"""A fixed corpus with the findings that it must give: each kind of file and each rule of the finders, with invented values.

The expected rows are written by hand from the rules. The registered queries make a file of it for each document, so all
finders, the gate, evidence, highlights, removal of contained findings and subsumption are compared with plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakwise.rules import patterns as p

GITHUB = "ghp_" + "Ab7" * 12
GITLAB = "glpat-" + "x9Y-" * 6
SLACK = "xoxb-" + "4cA9" * 8
CARDLESS = "live_" + "Rw5_" * 6
HEX = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"
MIXED = "mQ8rZ2tLw6Yb"
DATABASE = "postgres://svc:pw99@db.example:5432/app"

#: (repository index, path, text)
FILES = (
    # one match of the name pattern swallows both lines, so neither is an assignment; what is quoted is found by itself
    (0, "/a/src/Config.java", f'class Config {{\n String authTokenA = "{GITHUB}";\n String b = "{CARDLESS}";\n}}\n'),
    (0, "/a/src/main.go", f'package main\n\nvar slackToken = "{SLACK}"\n'),
    (0, "/a/src/Settings.kt", f'val clientSecret: String = "{MIXED}"\n'),
    (0, "/a/src/Creds.scala", f'val apiKey = "{MIXED}"\n'),
    (0, "/a/src/crypto.cpp", f'const char* digest = "{HEX}";\n'),
    (0, "/a/include/keys.hpp", f'static const char* my_salt = "{HEX}";\n'),
    (0, "/a/src/wide.cc", f'#define API_KEY L"{HEX}"\n'),
    (0, "/a/conf/app.xml", f'<app><db secretKey="{MIXED}"/><token>{HEX}</token><!-- none --></app>\n'),
    (0, "/a/conf/settings.yaml", f"app:\n  client_secret: '{MIXED}'\n"),
    (0, "/a/conf/package.json", f'{{\n  "authKey": "{MIXED}",\n  "n": 1\n}}\n'),
    (0, "/a/conf/flag.conf", '"secret_enabled": true,\n'),
    (0, "/a/conf/plain.conf", 'secret "abcdef12abcdefgh"\n'),
    (0, "/a/conf/database.conf", f"url {DATABASE}\n"),
    (0, "/a/src/deploy.rb", f'CONFIG = {{ :digest => "{HEX}" }}\n'),
    (0, "/a/views/index.erb", f'<% apiKey = "{MIXED}" %>\n'),
    (0, "/a/src/hash.php", f'"secretName" => "{MIXED}"\n'),
    (0, "/a/assets/notes.xyz", f'secret = "{HEX}"\n'),
    (0, "/a/src/plain.java", 'String name = "hello";\nString key = "two words";\n'),
    (0, "/a/tests/Check.java", f'String apiKey = "{MIXED}";\n'),
    (0, "/a/certs/server.pem", "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----\n"),
    (0, "/a/certs/public.crt", "-----BEGIN PUBLIC KEY-----\nabc\n-----END PUBLIC KEY-----\n"),
    (1, "/b/src/Client.java", f'class Client {{\n String x = "{GITHUB}";\n}}\n'),
    (1, "/b/conf/values.yaml", f"other: 1\nsecret: {HEX}\n"),
    (1, "/b/conf/lab.txt", f"use {GITLAB} here\n"),
)

_HEX_STRING = "SuspiciousOrCommonSecretString"
#: (repository index, path, provider, headline, confidence, value, first line, character, first byte, end, tag); a value of
#: None is that of a confidential file, whose hash is that of its content.
FINDINGS = (
    # the quoted token contains the vendor's finding at equal confidence
    (0, "/a/src/Config.java", _HEX_STRING, p.GITHUB, 4, GITHUB, 1, 21, 36, 78, ""),
    (0, "/a/src/Config.java", "GoCardless Token", "GoCardless Token", 4, CARDLESS, 2, 13, 93, 122, ""),
    # the assignment (High) overlaps the quoted token (Critical) and is subsumed
    (0, "/a/src/main.go", _HEX_STRING, p.SLACK, 4, SLACK, 2, 17, 31, 70, ""),
    (0, "/a/src/Settings.kt", "SecretAssignment", p.SECRET_ASSIGNMENT, 3, MIXED, 0, 4, 4, 41, ""),
    (0, "/a/src/Creds.scala", "SecretAssignment", p.SECRET_ASSIGNMENT, 3, MIXED, 0, 4, 4, 27, ""),
    # no secret-like name, so only the string is found
    (0, "/a/src/crypto.cpp", _HEX_STRING, p.ENCODED, 3, HEX, 0, 21, 21, 55, ""),
    (0, "/a/include/keys.hpp", "CPPSecretAssignment", p.SECRET_ASSIGNMENT, 3, HEX, 0, 19, 19, 63, ""),
    (0, "/a/src/wide.cc", "DefineSecretAssignment", p.SECRET_ASSIGNMENT, 3, HEX, 0, 8, 8, 51, ""),
    (0, "/a/conf/app.xml", "AttributeSecretAssignment", p.SECRET_ASSIGNMENT, 3, MIXED, 0, 9, 9, 32, ""),
    (0, "/a/conf/app.xml", "ElementSecretAssignment", p.SECRET_ASSIGNMENT, 3, HEX, 0, 42, 42, 73, ""),
    (0, "/a/conf/settings.yaml", "YAMLSecretAssignment", p.SECRET_ASSIGNMENT, 3, MIXED, 1, 2, 7, 37, ""),
    # the JSON match goes on to the line break, so its value keeps the comma and it contains the YAML match
    (0, "/a/conf/package.json", "JSONSecretAssignment", p.SECRET_ASSIGNMENT, 3, f'"{MIXED}",', 1, 3, 5, 31, ""),
    # evidence of no secret keeps the headline at Medium
    (0, "/a/conf/flag.conf", "JSONSecretAssignment", p.SECRET_ASSIGNMENT, 2, "true,", 0, 1, 1, 24, ""),
    (0, "/a/conf/plain.conf", "ConfSecretAssignment", p.SECRET_ASSIGNMENT, 2, "abcdef12abcdefgh", 0, 0, 0, 25, ""),
    (0, "/a/conf/database.conf", p.CONNECTION, f"Postgres Database {p.CONNECTION}", 3, DATABASE, 0, 4, 4, 43, ""),
    # this class has no arrow finder, the next but one has
    (0, "/a/src/deploy.rb", _HEX_STRING, p.ENCODED, 3, HEX, 0, 22, 22, 56, ""),
    (0, "/a/views/index.erb", "SecretAssignment", p.SECRET_ASSIGNMENT, 3, MIXED, 0, 3, 3, 26, ""),
    (0, "/a/src/hash.php", "ArrowSecretAssignment", p.SECRET_ASSIGNMENT, 3, MIXED, 0, 1, 1, 31, ""),
    (0, "/a/tests/Check.java", "SecretAssignment", p.SECRET_ASSIGNMENT, 3, MIXED, 0, 7, 7, 30, "test"),
    (0, "/a/certs/server.pem", "ConfidentialFiles", "Warning! You may be sharing confidential (RSA PRIVATE KEY) data with your code", 4, None, 0, 0, 0, 0, "confidential"),
    (0, "/a/certs/public.crt", "ConfidentialFiles", "Warning! You may be sharing confidential (PUBLIC KEY) data with your code", 0, None, 0, 0, 0, 0, "confidential"),
    (1, "/b/src/Client.java", _HEX_STRING, p.GITHUB, 4, GITHUB, 1, 12, 27, 69, ""),
    (1, "/b/conf/values.yaml", "YAMLSecretAssignment", p.SECRET_ASSIGNMENT, 3, HEX, 1, 0, 9, 50, ""),
    (1, "/b/conf/lab.txt", p.GITLAB, p.GITLAB, 3, GITLAB, 0, 4, 4, 34, ""),
)


#: A line that is put in front of files: four characters, five bytes.
FILLER = "# é\n"


#: A document's own tokens, of the length of the fixed ones; no run of ones, so that none is a common credential.
OWN_HEX = "translate(md5(cast(doc_id AS {text})), '1', 'a')"
OWN_MIXED = "concat('mQ8rZ', lpad(cast(doc_id % 97 AS {text}), 2, '0'), 'Lw6Yb')"


def _own(text: str, kind: str) -> str:
    """A SQL expression with the document's tokens in place of the fixed ones."""
    return f"replace(replace({text}, '{HEX}', {OWN_HEX.format(text=kind)}), '{MIXED}', {OWN_MIXED.format(text=kind)})"


def _filled(text: str) -> str:
    quoted = "'" + text.replace("'", "''") + "'"
    return _own(quoted, "VARCHAR")


def document_files(documents: DataFrame) -> DataFrame:
    """A file for each document, after ``doc_id``: one of ``FILES`` in a folder of its own, with up to four lines in front and
    its own tokens in place of the fixed ones."""
    n, lines = len(FILES), F.col("doc_id") % 5
    pick = lambda of: F.element_at(F.array(*map(F.lit, of)), (F.col("doc_id") % n + 1).cast("int"))
    path = F.concat(F.lit("/d"), F.col("doc_id").cast("string"), pick([x for _, x, _ in FILES]))
    rows = documents.select("doc_id", pick([i for i, *_ in FILES]).alias("repo_index"), path.alias("path"), pick([t for *_, t in FILES]).alias("text"))
    text = F.concat(F.repeat(F.lit(FILLER), lines.cast("int")), F.expr(_own("text", "string")))
    return rows.withColumn("text", text).withColumns({"content": F.encode("text", "utf-8"), "size": F.octet_length("text").cast("long")}).drop("doc_id")


def _highlight(text: str, provider: str, value: str | None, character: int, start: int, end: int) -> tuple[int, int]:
    """Characters of the highlight: from the byte before the value to its last; markup as a whole. The space after an
    arrow or a YAML key is part of the matched value and isn't counted as a quote, so there the highlight begins one
    character earlier."""
    if value is None:
        return 0, 0
    if provider in ("AttributeSecretAssignment", "ElementSecretAssignment"):
        return character, character + end - start
    raw = text.encode()
    spaced = provider in ("ArrowSecretAssignment", "YAMLSecretAssignment")
    first = raw.index(value.encode(), start) - 1 - spaced
    line = raw.rfind(b"\n", 0, first) + 1
    return first - line, first - line + len(value.encode())


def findings_sql(confidential: bool = True) -> str:
    """The expected rows of :func:`document_files`."""
    texts = {path: (i, text) for i, (_, path, text) in enumerate(FILES)}
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows, values, contents = [], [], []
    for number, (index, path, provider, headline, level, value, line, character, start, end, tag) in enumerate(FINDINGS):
        file, text = texts[path]
        if value is None and not confidential:
            continue
        shift = 0 if value is None else 1
        marks = _highlight(text, provider, value, character, start, end)
        rows.append(f"({number}, {file}, {index}, {quoted(path)}, {quoted(provider)}, {quoted(headline)}, {level}, {line}, {character}, {start}, {end}, {marks[0]}, {marks[1]}, {shift}, {quoted(tag)})")
        values.append(f"WHEN {number} THEN {_filled(value or '')}")
        if value is None:
            contents.append(f"WHEN {number} THEN repeat('{FILLER}', CAST(k AS INTEGER)) || {_filled(text)}")
    names = "number, file, repo_index, path, provider_id, headline, confidence, line, start_char, first, last, mark_from, mark_to, shift, tags"
    hashed = f"CASE number {' '.join(contents)} ELSE value END" if contents else "value"
    return f"""
WITH f({names}) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, doc_id % 5 AS k, doc_id % {len(FILES)} AS file FROM documents),
v AS (SELECT *, CASE number {" ".join(values)} END AS value FROM d JOIN f USING (file))
SELECT repo_index, '/d' || CAST(doc_id AS VARCHAR) || path AS location, provider_id, headline, confidence, CAST(line + shift * k AS BIGINT) AS start_line,
       CAST(start_char AS BIGINT) AS start_char, CAST(first + 5 * shift * k AS BIGINT) AS raw_start, CAST(last + 5 * shift * k AS BIGINT) AS raw_end,
       CAST(mark_from AS BIGINT) AS highlight_start_char, CAST(mark_to AS BIGINT) AS highlight_end_char, value, sha256({hashed}) AS sha256, tags
FROM v
"""
