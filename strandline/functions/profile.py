"""The grammar of a corpus: how its document codes, clauses and units look. Everything is a parameter; the default fits a corpus of standards whose codes begin with one prefix."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CorpusProfile:
    """Patterns without look-around, so that engines without it can run the same.

    ``kinds`` are the segments that say what a document is; ``informative`` those that never
    bind, whatever the run says.
    """

    prefix: str = "AXSS"
    kinds: tuple[str, ...] = ("ST", "AS", "HB", "TM")
    informative: tuple[str, ...] = ("HB", "TM")
    # Sizes of chunks in characters.
    target: int = 1_600
    slack: int = 900
    hard_max: int = 3_600
    min_chars: int = 400
    near_max: int = 50
    min_caption: int = 25

    @property
    def code(self) -> str:
        """A document code of the modern form."""
        return rf"{self.prefix}-[A-Z]-({'|'.join(self.kinds)})-[0-9]{{2}}(-[0-9]{{2}})*"

    @property
    def old_code(self) -> str:
        """The early form, which has no segment for the kind."""
        return rf"{self.prefix}-[A-Z]-[0-9]{{2}}(-[0-9]{{2}})*"

    @property
    def any_code(self) -> str:
        return f"({self.code}|{self.old_code})"

    @property
    def requirement(self) -> str:
        """A requirement id: the code of a binding document and a number."""
        binding = [k for k in self.kinds if k not in self.informative]
        return rf"\b{self.prefix}-[A-Z]-({'|'.join(binding)})-[0-9]{{2}}(-[0-9]{{2}})*_[0-9]{{4,}}\b"


DEFAULT = CorpusProfile()

# How numbered lines begin. A bare number counts in a heading only.
CLAUSE_DOTTED = r"^[ \t]*(([1-9]|1[0-9])(\.[0-9]{1,3}){1,4})[ \t]+\S"
CLAUSE_BARE = r"^[ \t]*([1-9]|1[0-9])[ \t]+[A-Z]"
ANNEX_NUMBER = r"^\s*([A-Z]\.[0-9]+(\.[0-9]+)*)\s+\S"
ANNEX_LETTER = r"^\s*[Aa][Nn][Nn][Ee][Xx]\s+([A-Za-z])\b"
LETTERED = r"^\s*[a-z][.)]\s+\S"
MODALS = ("shall", "should", "may", "can")
MODAL = r"\b(shall|should|may|can)\b"
ACRONYM = r"\b[A-Z][A-Za-z0-9/\-]{1,9}\b"
#: Words of a caption that says there is none, and phrases of one that says so in prose.
NO_CAPTION = ("none", "no", "n/a", "nothing")
NO_FIGURE = (
    r"there (are|is) no (figures|diagrams|drawings|schematics|images)|no (figures|diagrams|drawings|schematics) (or|are|is|present)"
    r"|does not (contain|include|have) any (figures|diagrams)|purely textual|only text|no visual|contains no (figures|diagrams)"
)
TERM = r"[A-Za-z][A-Za-z0-9-]+"
#: What is a term of the hashed index: whole codes first.
TOKEN = "{code}|" + TERM
