"""Fixed values of the publication checks, and their use as Spark regular expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

# --- fixed values: rule names, patterns and limits that results depend on -----------------------
SECRET_PATTERNS = {
    "aws-access-key": r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    "github-token": r"(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,})",
    "private-key": r"^-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "embedded-postgres-password": r"postgres(?:ql)?://[^\s/:]+:([^\s@]+)@",
    "jwt": r"eyJ[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}",
    "credential-literal": (
        r"\b(?:password|pwd|client_secret|aws_secret_access_key)\b\s*[:=]\s*['\"]?([^\s'\";,}\n]{8,})"
    ),
}
MULTILINE_RULES = {"private-key"}
IGNORE_CASE_RULES = {"embedded-postgres-password", "credential-literal"}
PLACEHOLDER_RULES = {"embedded-postgres-password", "credential-literal"}
PLACEHOLDER_MARKS = ["${", "<"]

BLOCKED_PARTS = ["datasets", "extracts", "generated_events", ".terraform", "output", "__pycache__"]
BLOCKED_SUFFIXES = [".csv", ".parquet", ".docx", ".pdf", ".pem", ".pfx", ".key", ".tfplan"]
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg"]
SIZE_LIMIT = 5_000_000

MARKDOWN_LINK = r"(?<!!)\[[^\]]+\]\(([^)]+)\)"
EXTERNAL_PREFIXES = ["https://", "http://", "mailto:", "#"]
# ------------------------------------------------------------------------------------------------

HTML_LINK = r'href="([^"]*)"'


@dataclass(frozen=True)
class TextRule:
    """A pattern over whole texts.

    ``secret_group`` holds the value tested for placeholders. Every match contains one of ``literals``,
    if any are given: a plain search for them spares most texts the regular expression.
    """

    name: str
    pattern: str
    ignore_case: bool = False
    multiline: bool = False
    secret_group: int | None = None
    literals: Sequence[str] = ()

    @property
    def regex(self) -> str:
        r"""The pattern for the JVM: Unicode classes, and ``^`` only after a line feed.

        Unicode ``\s`` of the JVM lacks the separators U+001C to U+001F, so they are added.
        """
        flags = "U" + ("i" if self.ignore_case else "") + ("dm" if self.multiline else "")
        spaces = self.pattern.replace(r"[^\s", "[^\\s\\x1c-\\x1f").replace(r"\s*", "[\\s\\x1c-\\x1f]*")
        return f"(?{flags}){spaces}"


# Derived from the patterns above; rules that ignore case have none.
_LITERALS = {
    "aws-access-key": ["AKIA", "ASIA"],
    "github-token": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"],
    "private-key": ["-----BEGIN "],
    "jwt": ["eyJ"],
}

SECRET_RULES = [
    TextRule(
        name,
        pattern,
        ignore_case=name in IGNORE_CASE_RULES,
        multiline=name in MULTILINE_RULES,
        secret_group=1 if name in PLACEHOLDER_RULES else None,
        literals=_LITERALS.get(name, ()),
    )
    for name, pattern in SECRET_PATTERNS.items()
]

@dataclass(frozen=True)
class FilePolicy:
    """What keeps a file from being published; by default the fixed values above."""

    blocked_parts: Sequence[str] = tuple(BLOCKED_PARTS)
    blocked_suffixes: Sequence[str] = tuple(BLOCKED_SUFFIXES)
    size_limit: int = SIZE_LIMIT


# Our own addition: quoted hexadecimal tokens, which the given documents do contain.
HEX_TOKEN_RULE = TextRule("hex-token", r'token = "[0-9a-f]{16,}"', literals=['token = "'])
