"""Template residue and error pages: evidence in what remains of a record without recurrent boilerplate.

1. Every text is split into lines. The lines, of any length, are normalised and counted by host over all different
   texts; those on a large share of a host's texts are its boilerplate.
2. Boilerplate is subtracted from every text of the host.
3. The rest is searched for evidence. Slots left unfilled and filler are evidence wherever they stand. Sentences that
   are wholly an error, access, waiting, maintenance or script message are evidence if nothing else remains but a
   title of a few words or links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import materialised

TITLE_WORDS = 8

NAME = r"[A-Za-z][A-Za-z0-9]*(?:[_ .-][A-Za-z0-9]+){0,4}"
LOWER_KEY = r"[A-Za-z][A-Za-z0-9]*(?:[_.-][A-Za-z0-9]+){0,5}"
UPPER_KEY = r"[A-Z][A-Z0-9]*(?:[_ -][A-Z0-9]+){0,4}"
ASKING = r"(?:insert|enter|your|add|type|choose|select|fill in|put|specify|placeholder|einfügen|hier|insérer|votre|insertar|su)"
# a value's place in the notation of some template language or form
SLOT = re.compile(
    "|".join(
        (
            rf"\{{\{{\s*{NAME}\s*\}}\}}",  # {{ name }}
            rf"\{{%\s*{NAME}\s*%\}}",  # {% name %}
            rf"<%=?\s*{NAME}\s*%>",  # <%= name %>
            rf"[$#]\{{\s*{NAME}\s*\}}",  # ${name} #{name}
            rf"(?<![\w{{$#])\{{{LOWER_KEY}\}}(?!\}})",  # {name}
            rf"%\({LOWER_KEY}\)[sdifr]",  # %(name)s
            rf"(?<![\w%])%{UPPER_KEY}%(?![\w%])",  # %NAME%
            rf"\[\[\s*{NAME}\s*\]\]",  # [[name]]
            rf"<<\s*{NAME}\s*>>",  # <<name>>
            rf"\[\s*{ASKING}\s+[^\]\n]{{1,40}}\]",  # [insert name here]
            rf"<\s*{ASKING}\s+[^>\n]{{1,40}}>",  # <enter name>
            r"\[[A-Z][A-Z0-9]{2,}(?:[_ -][A-Z0-9]+)*\](?!\()",  # [NAME]
            r"\[[A-Za-z]+(?:_[A-Za-z0-9]+)+\](?!\()",  # [drug_name]
            r"<[A-Z][A-Z0-9]{2,}(?:[_ -][A-Z0-9]+)*>",  # <NAME>
            r"<[A-Za-z]+(?:_[A-Za-z0-9]+)+>",  # <drug_name>
            r"(?<![\w_])__[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*__(?![\w_])",  # __NAME__
            rf"@@{LOWER_KEY}@@",  # @@name@@
        )
    )
)
# bracketed capitals that stand for themselves
NO_SLOT = re.compile(r"\[(?:SIC|URGENT|NEW|OK|TRUE|FALSE|NULL|NOTE|WARNING|INFO|ERROR|DEBUG|REDACTED|UNK|MASK|PAD|CLS|SEP|BOS|EOS|INST|EDIT|UPDATE)\]|<(?:UNK|PAD|CLS|SEP|BOS|EOS|MASK|START|END)>", re.I)

LATIN = set(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur".split()
)
DUMMY = set("test text texto texte blah bla asdf asdfasdf qwerty foo bar baz tbd tba todo dummy sample placeholder blindtext platzhalter fülltext mustertext relleno lorem filler content abc xyz".split())
# Sentences that stand in for content not yet written.
FILLER = re.compile(
    r"(?:(?:sample|dummy|placeholder|filler|example|some|your|the|insert|add|more|body) )?(?:text|content|description|note|copy)(?: goes| comes| will go| will be)? here"
    r"|(?:type|enter|write|insert|add|put) (?:your |the |some |a )?(?:note|text|message|content|comment|description|name|details)s? here"
    r"|(?:this|the) (?:paragraph|text|section|sentence|page|note|entry) is (?:only |just )?(?:a )?(?:placeholder|dummy text|filler|sample text)\b.*"
    r"|\[?(?:description|text|content|details|summary|information) (?:to follow|to come|coming soon|pending|tba|tbd|goes here)\]?"
    r"|(?:content|text|more|details) coming soon|to be (?:completed|added|filled in|written|determined|announced)"
    r"|(?:dummy|sample|placeholder|filler) (?:text|content)"
    r"|hier (?:steht|kommt|folgt|erscheint) (?:später |bald |noch )?(?:der |ein |ihr )?(?:text|inhalt)\b.*|(?:dies ist ein )?(?:blindtext|platzhalter(?:text)?|mustertext|fülltext|beispieltext)(?: (?:blindtext|platzhalter|mustertext))*|text folgt|inhalt folgt"
    r"|texte? (?:provisoire|à venir|de remplissage|factice|d'exemple|ici)|votre texte ici|(?:contenu|description) à venir|saisissez votre (?:texte|note) ici"
    r"|texto (?:de relleno|provisional|de ejemplo|de prueba|aquí|pendiente|simulado)|su texto aquí|(?:contenido|descripción) (?:pendiente|próximamente)|escriba (?:su|la) nota aquí"
    r"|yahan (?:text|likhein|likho|apna)\b.*|(?:text|vivaran) baad mein\b.*",
    re.I,
)

# every alternative of FILLER has one of these, so a sentence without them needs no closer look; the same for slots and dummies
FILLER_HINT = re.compile("here|placeholder|dummy|filler|sample|follow|com(?:e|ing)|pending|tb[ad]|complet|added|filled|written|determined|announced|hier|text|folgt|platzhalter|provis|venir|remplissage|factice|exemple|ici|relleno|ejemplo|prueba|aquí|pendiente|simulado|próximamente|yahan|baad")
DUMMY_HINT = re.compile(r"\b(?:" + "|".join(sorted(DUMMY | {"ipsum"})) + r"|x{3,})\b")
SLOT_HINT = re.compile(r"[{\[<%]|@@|__")

CODE = r"(?:4\d\d|5\d\d)"
STATUS = r"(?:not found|page not found|file not found|forbidden|unauthori[sz]ed|bad request|bad gateway|service (?:temporarily )?unavailable|(?:internal )?server error|gateway time-?out|too many requests|request time-?out|method not allowed)"
THING = r"[\w' -]{1,60}"
# Whole messages of servers and browsers, by what they say; a trailing full stop is left out.
MESSAGE = re.compile(
    "|".join(
        (
            rf"(?:http |error |status |fehler |erreur )*\(?{CODE}\)?(?:\s*[:|–-]\s*|\s+)?(?:error\s*)?{STATUS}",
            rf"{STATUS}(?:\s*[:–-]?\s*\(?(?:error )?{CODE}\)?)?",
            rf"(?:http |server )?error(?: code)?:? {CODE}(?:\s*[:–-]\s*{THING})?|{CODE} error",
            rf"(?:sorry, )?(?:the |this |that )?(?:page|file|url|document|resource|record|address) (?:that )?(?:you (?:asked for|requested|are looking for|were looking for|want)|requested)?\s*(?:does not exist|doesn't exist|could not be found|couldn't be found|cannot be found|can't be found|was not found|is not available|is unavailable|has moved|has been removed)(?: (?:on|from) this (?:server|site))?",
            rf"(?:sorry, )?we (?:couldn't|could not|can't|cannot) find (?:what|the|that|this){THING}",
            r"(?:sorry|oops)?[,!. ]*something went wrong(?: on our (?:end|side))?|oops|sorry|an? (?:unexpected |unknown |internal )?error (?:has )?occurred(?: while [\w ]{1,50})?",
            r"(?:error establishing a )?database connection(?: failed| error| lost)?(?:: [\w ]{1,40})?|(?:the )?(?:connection|request|server|session) (?:has )?(?:timed out|time-?out|was reset|was refused|refused|failed|is not responding)(?: while [\w ]{1,50})?(?:: [\w ]{1,40})?",
            r"traceback \(most recent call last\):?.*|\w+(?:error|exception): .{0,80}|(?:uncaught |fatal |unhandled )(?:error|exception).{0,80}|segmentation fault.{0,30}|stack trace:?.*",
            r"(?:this|the) (?:content|page|video|site|service|leaflet|record|item) is (?:currently |temporarily )?(?:not available|unavailable|blocked|restricted)(?: in your (?:region|country|area))?",
            rf"access(?: is| was| to this (?:page|site|resource|record|leaflet) (?:is|was|has been))? (?:denied|forbidden|restricted)|permission denied|you (?:do not|don't) have (?:the )?(?:permission|access|rights)(?: to {THING})?|you (?:are not|must be) (?:authori[sz]ed|logged in|signed in)(?: to {THING})?",
            rf"(?:your |the )?session (?:has )?(?:expired|ended|timed out)|(?:please )?(?:log|sign) ?in(?: again)?(?: (?:to|in order to) {THING})?|log ?in required|(?:please )?authenticate(?: to {THING})?",
            rf"checking your browser(?: before {THING})?|(?:please )?wait(?: a moment| while {THING})?|just a moment|loading|one moment please|verifying (?:that )?you are (?:a )?human|you are being redirected|redirecting|please complete the captcha(?: to {THING})?",
            r"this (?:may|can|will|should) take (?:up to |about )?(?:a few|several|some|\d+) (?:seconds|minutes|moments)",
            r"(?:scheduled |site |system |server )?maintenance(?: mode| in progress| work| under way| underway)?|(?:the |this |our )?(?:site|page|server|service|system|drug index|index|database) is (?:currently |temporarily )?(?:down|offline|under maintenance|being updated|undergoing maintenance|down for maintenance)(?: for (?:scheduled )?maintenance)?|we(?:'ll| will) be (?:right )?back (?:soon|shortly|later)|under construction|temporarily (?:down|offline)(?: for maintenance)?",
            r"(?:the |this |our )?[\w ]{1,30} will (?:return|be back|be available(?: again)?) (?:shortly|soon|later)",
            rf"(?:please |you must |you need to |you have to |to continue,? )?(?:enable|activate|allow|turn on|switch on) (?:java ?script|scripts?|scripting|cookies)(?: and (?:java ?script|scripts?|cookies))?(?: in your browser)?(?: and reload)?(?:,? (?:to|in order to) {THING})?",
            rf"(?:this|the|our) (?:site|page|website|service|chart|checker|application|app|leaflet) (?:requires|needs) (?:java ?script|scripts?|scripting)(?: to (?:be (?:enabled|turned on|on|active)|{THING}))?|(?:java ?script|scripts?|scripting) (?:is|are|must be|needs to be|has to be|have to be) (?:disabled|required|turned off|off|needed|blocked|not enabled|not available|not supported|on|enabled|active|turned on)(?: (?:in your browser|to {THING}|for {THING}))?",
            rf"your browser (?:does not|doesn't) support (?:java ?script|scripts?|scripting|this feature)(?:,? so {THING})?|turn it on and reload(?: the page)?|noscript:? .{{0,70}}",
            # German, French, Spanish, Hindi in Latin letters
            rf"(?:die |diese )?seite (?:wurde )?nicht gefunden|(?:die )?(?:angeforderte )?seite existiert nicht|zugriff verweigert|keine berechtigung.{{0,30}}|(?:ein )?(?:interner |unbekannter )?(?:server)?fehler(?: ist aufgetreten)?|wartungsarbeiten|wartung läuft|bitte (?:warten|melden sie sich (?:erneut |wieder )?an|prüfen sie die adresse|versuchen sie es (?:später )?(?:erneut|noch einmal))(?:.{{0,30}})|(?:ihre )?sitzung ist abgelaufen|bitte (?:aktivieren|schalten) sie java ?script.{{0,50}}|java ?script (?:ist deaktiviert|muss aktiviert sein|wird benötigt).{{0,30}}|ihr browser unterstützt kein.{{0,40}}",
            rf"(?:la )?page (?:introuvable|non trouvée|demandée n'existe pas|n'existe pas)|accès (?:refusé|interdit)|une erreur (?:est survenue|s'est produite|interne).{{0,30}}|erreur (?:interne )?(?:du )?serveur|(?:site en |en cours de )?maintenance(?: en cours)?|veuillez (?:vous (?:re)?connecter|patienter|réessayer|activer java ?script).{{0,50}}|(?:votre )?session (?:a )?expirée?|activez (?:le )?java ?script.{{0,50}}|java ?script (?:est désactivé|doit être activé|est requis).{{0,30}}|votre navigateur ne (?:prend pas en charge|supporte pas).{{0,40}}",
            rf"(?:la )?página (?:no encontrada|no existe|solicitada no existe)|acceso (?:denegado|prohibido|restringido)|(?:ha ocurrido|se ha producido|se produjo) un error.{{0,30}}|error (?:interno )?del servidor|(?:sitio )?en mantenimiento|mantenimiento en curso|(?:por favor,? )?(?:espere|inicie sesión|vuelva a iniciar sesión|inténtelo (?:de nuevo )?más tarde)(?:.{{0,30}})|vuelva al inicio|(?:su )?sesión ha (?:caducado|expirado)|(?:por favor,? )?(?:active|habilite|activa) java ?script.{{0,50}}|java ?script (?:está desactivado|es necesario|debe estar activado).{{0,30}}|su navegador no (?:admite|soporta).{{0,40}}",
            r"page nah[i]+n? mil[ai]|kripya (?:login|pratiksha|intezaar|java ?script).{0,40}|java ?script (?:chalu|on) (?:karein|karo|kijiye).{0,40}|kuch galat ho gaya",
        )
    ),
    re.I,
)
# What accompanies such messages.
COMPANION = re.compile(
    r"(?:please )?(?:try|check|come) (?:again|back)(?: (?:in|after) \d+ \w+| later| soon| shortly)?|retry|reload(?: the page)?|refresh(?: the page)?"
    r"|(?:please )?(?:go |click here to go )?(?:back|return) to (?:the )?(?:start|home|front|main|previous)(?: ?page)?|(?:please )?contact (?:support|us|the administrator|the site owner|your administrator).{0,30}"
    r"|(?:please )?check the (?:address|url|link)(?: and try again)?|(?:request|error|reference|incident|ray|session|trace|correlation)(?: ?(?:id|code|number|no))?[:# ]+[\w-]{2,}"
    r"|home(?:page)?|search|help|menu|login|sign in|contact|imprint|privacy|cookies?|(?:[\w ]{1,20} ?[|·»>/] ?)+[\w ]{1,20}|(?:©|\(c\)|copyright).{0,40}"
    r"|zurück zur startseite|retour à l'accueil|volver al inicio|startseite|accueil|inicio",
    re.I,
)
# a message, and links or the like that follow without a full stop
WHOLE = re.compile(rf"(?:{MESSAGE.pattern})(?:[\s|·–—-]+(?:{COMPANION.pattern}))*", re.I)
# a title does not break off after one of these
UNFINISHED = set("a an and are as at be been but by for from had has have in is it its la le not of on or said says shows showed that the then this to was were with wrote".split())
SENTENCE_END = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+")
LINES = re.compile(r"[\r\n  \x0b\x0c]+")
WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
EDGES = " \t ​﻿.!?…\"'“”’*-–—•|^~=_"


def is_filler(sentence: str) -> bool:
    """Whether a sentence, or its end behind a title, only stands in for content."""
    core = sentence.strip(EDGES)
    low = core.lower()
    for m in FILLER.finditer(core) if FILLER_HINT.search(low) else ():
        if m.end() == len(core) and len(WORDS.findall(core[: m.start()])) <= TITLE_WORDS and (not m.start() or not core[m.start() - 1].isalnum()):
            return True
    if not DUMMY_HINT.search(low):
        return False
    words = [w.lower() for w in WORDS.findall(core)]
    if sum(w in ("lorem", "ipsum") for w in words) >= 1 and sum(w in LATIN for w in words) >= 4:
        run = best = 0
        for w in words:
            run = run + 1 if w in LATIN else 0
            best = max(best, run)
        if best >= 4:
            return True
    run = 0
    last = None
    for w in words:
        dummy = w in DUMMY or re.fullmatch(r"x{3,}", w) is not None
        same = dummy and (w == last or last is None or re.fullmatch(r"x{3,}", w) is not None and re.fullmatch(r"x{3,}", last) is not None)
        run = run + 1 if same else (1 if dummy else (run if w.isdigit() and run else 0))
        last = w if not w.isdigit() else last
        if run >= 3 or run >= 2 and len(words) == 2:
            return True
    return False


def message_at(sentence: str) -> int | None:
    """Where a message begins that reaches to the end of the sentence, behind a title at most; None if there is none."""
    core = sentence.rstrip(EDGES + ":")
    starts = [0] + [m.start() for m in WORDS.finditer(core)][: TITLE_WORDS + 1]
    lead = len(core) - len(core.lstrip(EDGES))
    for at in sorted({lead, *starts}):
        m = WHOLE.fullmatch(core, at)
        if m and m.group() and (at == lead or WORDS.findall(core[:at])[-1:] != [] and WORDS.findall(core[:at])[-1].lower() not in UNFINISHED):
            return at
    return None


def read(text: str) -> tuple[bool, bool, bool, bool, int]:
    """Slot, filler and message evidence; whether a sentence of content remains; how many words are left besides.

    Messages are looked for until a sentence of content is found, because beside content they are no evidence.
    """
    slot = SLOT_HINT.search(text) is not None and any(not NO_SLOT.fullmatch(m.group()) for m in SLOT.finditer(text))
    filler = message = content = False
    left = 0
    for line in LINES.split(text):
        for sentence in SENTENCE_END.split(line.strip()):
            core = sentence.strip(EDGES)
            if not core:
                continue
            if is_filler(sentence):
                filler = True
                continue
            if content:  # then no message can be all there is
                continue
            at = message_at(sentence)
            if at is not None:
                message = True
                left += len(WORDS.findall(sentence[:at]))
                continue
            if COMPANION.fullmatch(core):
                continue
            count = len(WORDS.findall(core))
            if count > TITLE_WORDS or count >= 3 and sentence.rstrip("\"'”’) ")[-1:] in ".!?…":
                content = True
            else:
                left += count
    return slot, filler, message, content, left


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        reasons = []
        for text in batch.column("text").to_pylist():
            slot, filler, message, content, left = read(text)
            reasons.append("slot" if slot else "filler" if filler else "message" if message and not content and left <= TITLE_WORDS else None)
        found = pa.array([k for k, r in enumerate(reasons) if r], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(found), pa.array([r for r in reasons if r], pa.string())], names=["doc_id", "reason"])


def lines_of(text: Column) -> Column:
    """The lines of a text, as they stand."""
    return F.split(text, LINES.pattern)


def normalised(line: Column) -> Column:
    """The line as it recurs: white space squeezed, capitalised words behind the first masked, lower case, digits masked."""
    squeezed = F.trim(F.regexp_replace(line, r"[\s\p{Z}]+", " "))
    return F.regexp_replace(F.lower(F.regexp_replace(squeezed, r"(?<=\S )\p{Lu}\S*", "¤")), r"\p{Nd}", "0")


def boilerplate(docs: DataFrame, recurrent: int = 3, share: float = 0.05) -> DataFrame:
    """``host, lines``: hashes of the normalised lines of any length that ``recurrent`` or more different texts of the
    host have, and at least ``share`` of all its different texts. Every list has at most ``1 / share`` times as many lines
    as the host's texts have on average. Blank lines don't count. A null host is a host of its own."""
    pages = docs.select("host", "text", F.xxhash64("text").alias("page")).where("trim(text) != ''")
    sizes = pages.select("host", "page").distinct().groupBy(F.col("host").alias("h")).agg(F.count(F.lit(1)).alias("pages"))
    hashes = F.transform(F.filter(F.transform(lines_of(F.col("text")), normalised), lambda x: x != ""), lambda x: F.xxhash64(x))
    counts = pages.select("host", "page", F.explode(F.array_distinct(hashes)).alias("line")).distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    often = counts.where(F.col("n") >= recurrent).join(sizes, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") >= share * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("line").alias("lines"))


#: Hosts up to which the lists of recurrent lines are broadcast; beyond it they are joined by a shuffle.
MOST_HOSTS = 200_000


def residue(docs: DataFrame, recurrent: int = 3, share: float = 0.05) -> DataFrame:
    """``doc_id, reason`` of every document to exclude; reason is ``slot``, ``filler`` or ``message``, the first that holds.

    ``docs``: ``doc_id, host, text``; extra columns are ignored. First the lines that recur on the host are subtracted
    (see ``boilerplate``), then evidence is looked for in the rest: a slot or filler anywhere, or messages with no more
    than a title of eight words and links beside them. A text that is nothing but recurrent lines counts as it stands.

    Null, empty and blank texts are no case, whatever their number. A null host is a host of its own. Repeated rows
    give repeated results, and count once for recurrence. Very long texts are read whole. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "host", "text")
    recurring = materialised(boilerplate(docs, recurrent, share)).withColumnRenamed("host", "h")
    recurring = F.broadcast(recurring) if recurring.count() <= MOST_HOSTS else recurring
    kept = F.array_join(F.filter(lines_of(F.col("text")), lambda x: ~F.array_contains("lines", F.xxhash64(normalised(x)))), "\n")
    rest = F.transform(F.array(kept), lambda k: F.when(F.trim(k) != "", k).otherwise(F.col("text")))[0]
    left = docs.where("trim(text) != ''").join(recurring, F.col("host").eqNullSafe(F.col("h")), "left").select("doc_id", F.when(F.col("lines").isNull(), F.col("text")).otherwise(rest).alias("text"))
    return left.mapInArrow(_scanned, f"doc_id {dict(docs.dtypes)['doc_id']}, reason string")
