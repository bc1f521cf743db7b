"""Template residue, filler and error-page text instead of content.

Everything is decided by expressions on the folded text: delimiter-specific grammars for unfilled
placeholders (code spans and tutorial passages are discounted by context and density), lexical
tests for filler, and anchored grammars for messages and notices, which a text that describes
something is not held to. Filler of invented words is told by the vocabulary of all other texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import folded, trimmed
from strandline.runtime import written

# Fixed values. All patterns apply to lower-case text and use neither look-around nor
# back-references, so that an engine without them can run the same.
NAME = r"[\p{L}_][\p{L}\p{N}_. -]*"
#: One grammar for each kind of delimiter.
PLACEHOLDERS = (
    r"\{\{[^{}\n]*\}\}",
    r"[$#]\{[^{}\n]+\}",
    r"<%[^%\n]+%>",
    r"%\([\p{L}_][\p{L}\p{N}_.]*\)[sdifr]",
    r"@@[\p{L}\p{N}_. -]+@@",
    rf"__{NAME}__",
    r"\[\[[^\[\]\n]+\]\]",
    r"<<[^<>\n]+>>",
    r"\{([0-9]{1,3}|[a-z]+([_.][a-z]+)+|[a-z]{4,})\}",
    r"<(insert|your|enter|add|put|replace|type)([^\p{L}<>\n][^<>\n]*)?>",
    r"\[([^\[\]\n]*[^\[\]\n\p{L}])?(to be (added|completed|defined|confirmed|inserted|supplied|written|replaced|provided)|insert|describe|add|enter|your|placeholder|tbd|tbc|todo|einfügen|einsetzen|ergänzen|eintragen|à compléter|à remplacer|à insérer|insérer|completar|insertar|rellenar)([^\[\]\n\p{L}][^\[\]\n]*)?\]",
    r"(^|\s)%[sd](\s|[.,;]|$)",
    r"(^|[^\p{L}\p{N}])x{3,}([^\p{L}\p{N}]|$)",
    r"(^|\s)_{3,}([\s.,;:]|$)",
)
PLACEHOLDER = "|".join(f"({p})" for p in PLACEHOLDERS)
#: Code, which may hold such marks on purpose, and the words of texts that explain them.
CODE_SPAN = r"```[^`]*```|`[^`\n]+`"
TUTORIAL = r"\b(syntax|template engine|templating|variable|variables|example|tutorial|snippet|escape|escaped|literal|renders?|interpolat\w*)\b"
#: What may stand before a text: page or figure labels.
LABEL = r"^([\s\x0B\p{Z}]*(\[[0-9]{1,5}\]|(fig|figure|page|pg|p|abb|abbildung|seite|bild|planche|figura|página)[.]?[\s\p{Z}]*[0-9]{1,5})[\s\p{Z}]*[:|.–—-]?[\s\p{Z}]*)+"
FILLER = (
    r"lorem ipsum",
    r"\b(caption|description|text|title|content)s? (goes|go|comes|come) here\b",
    r"\b(dummy|sample|placeholder|filler|example|test) ((figure|image|picture|diagram) )?(caption|description|text|title|label|content|entry)\b",
    r"\b(to be replaced|replace this|please replace|bitte ersetzen|à remplacer|a reemplazar)\b",
    r"\bfor layout purposes\b",
    r"\b(blindtext|fülltext|platzhaltertext|faux[- ]texte|texte de remplissage|texto de relleno|texto simulado)\b",
    r"^(please )?(type|enter|write|insert|add|put) (a|an|the|your) ([\p{L}]+ )?(caption|description|text|title)\b",
    r"^(click|tap) (here )?to (add|edit|enter)\b",
    r"^(tbd|tbc|todo|fixme|untitled|no title|new figure)[.!]?$",
)
MESSAGES = (
    r"^(http[ /]*[0-9.]*[ :]*)?[45][0-9]{2}[ :-]+(bad|not|forbidden|internal|service|gateway|too|unauthori[sz]ed|payment|method|request|conflict|gone|error)",
    r"^http[ /]*[0-9.]*[ :]*[45][0-9]{2}\b",
    r"^(internal server error|server error|bad gateway|bad request|gateway time-?out|service (is )?(temporarily )?unavailable|not found|page not found|file not found|forbidden|unauthori[sz]ed|too many requests|access (is |was )?denied|permission denied|request (timed out|failed|rejected|timeout)|connection (reset|refused|timed out|closed|lost|error|aborted)|timed? ?out\b|rate limit|quota exceeded)",
    r"^(uncaught |unhandled |fatal |runtime |unexpected |syntax |type |value |key |io )?(error|exception|errno|fehler|erreur)\b[ :#(]",
    r"^(traceback \(most recent call last\)|stack ?trace|segmentation fault|core dumped|out of (device |gpu |cuda )?memory|null pointer|undefined is not|cannot read propert|assertion failed|panic:|killed\b|aborted\b)",
    r"^(your |the )?(session|login|token|licen[cs]e|link)( has| is)? (expired|timed out|invalid)",
    r"^(the |this )?(requested )?(image|page|resource|url|file|document|content|service|server|figure|drawing)( you requested)? (could not|cannot|can't|was not|is not|isn't|does not|did not|failed|has been removed|no longer)",
    r"^(we |i )?(failed to|unable to|could not|couldn't|cannot|can't|are sorry|am sorry|'re sorry|'m sorry)\b",
    r"^(sorry|oops|whoops|something went wrong|an? (unexpected |internal |unknown )?error (has )?occurred|there was (a|an) (problem|error))",
    r"^(das |die |der )?(seite|datei|bild|dienst|server|abbildung|zugriff)( ist| wurde| konnte)?( nicht| verweigert| derzeit| abgelaufen| nicht gefunden)",
    r"^(la |le |el |l')?(page|fichier|image|service|página|servicio|imagen|archivo|acceso|accès|serveur|servidor)( est| n'est| n'a| no| demandée?)? ?(introuvable|indisponible|refusé|denegado|no disponible|pas|se pudo|se encontr|está disponible)",
    r'^[{\[]\s*"?(error|errors|message|code|status|detail|exception|fault)"?\s*:',
)
SCRIPTS = r"(java ?scripts?|scripts?|scripting|cookies?)"
NOTICES = (
    rf"^(please |you (need|have|must|should)( to)? |to (view|see|continue|proceed)[^.]{{0,60}} |kindly )*(enable|activate|turn on|switch on|allow|accept|unblock)\b[^.]{{0,40}}\b{SCRIPTS}\b",
    rf"^[^.]{{0,60}}\b{SCRIPTS}\b[^.]{{0,20}}\b(must|has to|have to|need to|needs to|should|is|are)( be)?( currently)? (required|accepted|enabled|needed|disabled|blocked|turned off|switched on|turned on|allowed|activated)\b",
    rf"^(this |the |your |our )[\p{{L}} ]{{1,30}} (needs?|requires?) {SCRIPTS}\b",
    rf"\b(without|no) (java)?scripts?\b.{{0,40}}$|^noscript\b|^[^.]{{0,80}}\bnot available without {SCRIPTS}\b",
    r"^(your|this|the|ihr|votre|su|tu) (browser|web browser|viewer|navigateur|navegador)\b.{0,40}\b(does not|doesn't|do not|cannot|can't|is not|isn't|is no longer|is too old|is outdated|unterstützt|ne |n'|no )",
    r"^(checking|verifying) (your|that you|if you|the) (browser|are|connection|site)",
    r"^(please )?(update|upgrade|change|switch) (your|to (a|another)) [\p{L} ]{0,20}browser",
    rf"^(bitte )?(aktivieren|erlauben|akzeptieren|schalten) sie\b.{{0,40}}\b{SCRIPTS}\b",
    rf"^(merci d'|veuillez |vous devez )?(activer|activez|autoriser|autorisez|accepter|acceptez)\b.{{0,40}}\b{SCRIPTS}\b",
    rf"^(por favor,? )?(active|activa|habilite|habilita|acepte|debe activar|debe habilitar|permita)\b.{{0,40}}\b{SCRIPTS}\b",
    rf"^{SCRIPTS} (ist|sind|est|sont|está|están)\b",
)
#: A text that opens like this describes something, whatever it goes on to mention.
DESCRIPTION = r"^(a |an |the |this )?([\p{L}-]+[ -]){0,3}(diagram|chart|plot|graph|photograph|photo|view|layout|drawing|sketch|section|screenshot|schematic|map|table|template|tree|set|connection|wiring|picture|rendering|holder|panel|sequence) (of|showing|shows|in which|with|for|between|that|from|on)\b"
#: Words that some sentence of five words or more has, in the languages of the texts.
FUNCTION_WORDS = (
    "a an and are as at be been by for from had has have in into is it its no not of on or that the then this to was were which while with within without "
    "aus auf bei das dem den der des die durch ein eine einem einen einer für im in ist mit nach nicht oder sich sind und unter vom von vor wird werden zu zum zur "
    "au aux avec ce ces dans de des du elle en entre est et il la le les leur mais ne ou par pas pour que qui sa se ses son sont sous sur un une vers "
    "al como con contra cuando del desde donde el en entre es esta este hasta la las lo los más no o para pero por que se sin sobre son su sus un una y"
).split()
#: Words of filler Latin.
LATIN = (
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi "
    "aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
#: Filler: at least so many words; at most this share of different words, or of different pieces of three letters.
LEAST_WORDS, DIFFERENT_WORDS, DIFFERENT_PIECES, LATIN_SHARE = 5, 0.4, 0.8, 0.6
#: Words of filler that other texts may have, too, at most; and of filler of a few syllables.
KNOWN_SHARE, SCRAMBLED_SHARE = 0.2, 0.6
#: A placeholder counts as explained, not left over, in a text with two tutorial words and fewer than one placeholder in so many characters.
DENSITY = 200


@dataclass(frozen=True)
class Residue:
    """The reasons for which a text is residue; each is true, false, or null for a null text."""

    placeholder: Column
    filler: Column
    message: Column
    notice: Column

    #: The words of the text, and whether some of them is one that sentences cannot do without.
    words: Column
    sentence: Column
    #: Whether few syllables make up the words; with unknown words it tells filler.
    scrambled: Column

    @property
    def reason(self) -> Column:
        """The first reason that holds; null for a text that is no residue by itself."""
        return F.when(self.placeholder, "placeholder").when(self.filler, "filler").when(self.message, "message").when(self.notice, "notice")


def residue(text: Column) -> Residue:
    """Judge a text. Blank and short texts and ordinary descriptions are no residue; texts of any length are judged whole."""
    whole = folded(text)
    bare = F.regexp_replace(whole, CODE_SPAN, " ")
    marks = F.regexp_count(bare, F.lit(PLACEHOLDER))
    explained = (F.regexp_count(bare, F.lit(TUTORIAL)) >= 2) & (marks * DENSITY < F.length(bare))
    core = trimmed(F.regexp_replace(whole, LABEL, ""))
    tokens = F.regexp_extract_all(core, F.lit(r"\p{L}+"), F.lit(0))
    n = F.size(tokens)
    pieces = F.flatten(F.transform(tokens, lambda w: F.regexp_extract_all(w, F.lit(r"\p{L}{1,3}"), F.lit(0))))
    some = F.greatest(n, F.lit(1))
    latin = F.size(F.filter(tokens, lambda w: w.isin(LATIN)))
    repeated = F.size(F.array_distinct(tokens)) / some <= DIFFERENT_WORDS
    one_letter = F.forall(tokens, lambda w: F.size(F.array_distinct(F.split(w, ""))) <= 2) & (n >= LEAST_WORDS - 1)
    # a text of nothing but such words is filler as a whole
    placeholder = (marks > 0) & ~explained & ~one_letter
    # a few syllables that come back again and again
    sentence = F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in sorted(set(FUNCTION_WORDS))]))
    scrambled = (F.size(F.array_distinct(pieces)) / F.greatest(F.size(pieces), F.lit(1)) <= DIFFERENT_PIECES)
    filler = core.rlike("|".join(f"({p})" for p in FILLER)) | ((n >= LEAST_WORDS) & (repeated | (latin / some >= LATIN_SHARE))) | ((n > 0) & one_letter)
    describes = core.rlike(DESCRIPTION)
    message = core.rlike("|".join(f"({p})" for p in MESSAGES)) & ~describes
    notice = core.rlike("|".join(f"({p})" for p in NOTICES)) & ~describes
    return Residue(placeholder, filler, message, notice, tokens, sentence, scrambled)


def reasons(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, reason of every text that is residue: placeholder, filler, message or notice; one row for each key and reason.

    Besides what ``residue`` says of a text alone, one is filler if it has five words or more,
    none of which a sentence needs, and at most ``KNOWN_SHARE`` of its words stand in any text
    that is a sentence and no residue (``SCRAMBLED_SHARE`` where few syllables make up its words).
    The vocabulary is that of all texts; where none is a sentence no word is known. Null and blank
    texts give no row.
    """
    r = residue(F.col(f"`{text}`"))
    judged = rows.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), r.reason.alias("reason"), r.words.alias("words"), r.sentence.alias("sentence"), r.scrambled.alias("scrambled"))
    judged = written(judged.distinct(), "judged")
    odd = judged.where(F.col("reason").isNull() & ~F.col("sentence") & (F.size("words") >= LEAST_WORDS)).select("key", F.monotonically_increasing_id().alias("n"), "words", "scrambled")
    each = odd.select("key", "n", "scrambled", F.explode("words").alias("word"))
    known = judged.where(F.col("reason").isNull() & F.col("sentence")).select(F.explode(F.array_distinct("words")).alias("word")).distinct().withColumn("known", F.lit(True))
    share = each.join(known, "word", "left").groupBy("key", "n", "scrambled").agg(F.avg(F.coalesce("known", F.lit(False)).cast("double")).alias("share"))
    strange = share.where(F.col("share") <= F.when(F.col("scrambled"), SCRAMBLED_SHARE).otherwise(KNOWN_SHARE)).select("key", F.lit("filler").alias("reason"))
    return judged.where("reason is not null").select("key", "reason").unionByName(strange).distinct()
