"""Problem 10: template residue, filler and error pages.

Lines are normalised and counted by host (the documents' domain) over distinct texts. A line that surely stands in most of a
host's texts is its boilerplate, a menu or banner that stands beside the content and not in its place. Each document is
searched for evidence: unfilled placeholders and filler in its whole text, however often they recur; messages of a server,
viewer, converter or sign-in, and notices that scripts are required, in the residual that is left without the boilerplate.
Where hardly anything is left, there is no content the boilerplate could stand beside, so all of the text is searched; an
error page doesn't hide behind its own repetition.

Each pattern asks for the form such a message has: a status code with its reason phrase, something said to the reader or of
the thing asked for, at the start of a sentence; so sentences about such things don't match. Quoted placeholders are mentions,
not residue. All plain strings of which every match of a pattern holds one are looked for in one pass of an Aho-Corasick
automaton over the text; only the patterns whose strings occur are tried.

Defined results: null ids and null, empty and blank texts are no case; a null domain is a host of its own; copies of a text
count once; a host of so few texts that nothing can be told has no boilerplate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import cut, small

#: A line is boilerplate if the share of a host's distinct texts that hold it is surely above SHARE: the lower end of Wilson's
#: interval at SURE deviations.
SHARE, SURE = 0.5, 1.64
#: A residual of fewer characters is no content.
RESIDUE = 200
KINDS = ["placeholder", "filler", "error", "script"]

#: Syllables of the customary filler passage, and the words of the passages filler is taken from.
SYLLABLES = "lo rem ip sum do lor sit am et con sec te tur ad ipi sci ng eli ali sed eius mod tem por in ci di dunt ut la bo re mag ma gna qua quis qui nos trud ve ni mi no li si pi co".split()
LATIN_WORDS = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex "
    "ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id "
    "est laborum perspiciatis unde omnis iste natus error voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis quasi architecto beatae vitae dicta "
    "explicabo nemo ipsam quia voluptas aspernatur aut odit fugit consequuntur magni dolores eos ratione sequi nesciunt neque porro quisquam dolorem adipisci numquam eius modi tempora incidunt magnam "
    "aliquam quaerat".split()
)
#: Reason phrases of the status codes of HTTP for errors.
REASONS = (
    "bad request|unauthori[sz]ed|payment required|forbidden|(?:page )?not found|method not allowed|not acceptable|proxy authentication required|request time-?out|conflict|gone|length required|precondition failed"
    "|(?:payload|content|request entity) too large|(?:request-)?ur[il] too long|unsupported media type|range not satisfiable|expectation failed|misdirected request|unprocessable (?:entity|content)|locked"
    "|failed dependency|too early|upgrade required|precondition required|too many requests|request header fields too large|unavailable for legal reasons|internal server error|not implemented|bad gateway"
    "|service (?:temporarily )?unavailable|gateway time-?out|http version not supported|insufficient storage|loop detected|network authentication required"
)
#: Nouns of what is to be filled in.
SLOTS = "NAME|DATE|TIME|ID|ADDRESS|NUMBER|NO|TITLE|COMPANY|CLIENT|CUSTOMER|EMAIL|PHONE|AMOUNT|SIGNATURE|LOCATION|CITY|COUNTRY|TEXT|VALUE|DESCRIPTION|PLACEHOLDER|URL|LINK|PROJECT|DEPARTMENT|AUTHOR|RECIPIENT|SENDER|SUBJECT|PRICE|QUANTITY"

_NAME = "[A-Za-z][\\w .:-]{0,40}?"
_ANY = "[^\\[\\]{}<>\\n]{1,60}?"
_QUOTE = "\"“”'‘’`«"
_START = "(?:^|[.!?>\\]:|] )\\s*"
_THING = "(?:item|page|document|file|drawing|sheet|record|article|content|resource)"


def branching(words: list[str]) -> str:
    """A pattern for any of the words that tells them apart letter by letter, so that few alternatives are tried."""
    if words == [""]:
        return ""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    arms = [h + branching(sorted(t)) for h, t in sorted(heads.items())]
    body = arms[0] if len(arms) == 1 else "(?:" + "|".join(arms) + ")"
    return body if "" not in words else f"(?:{body})?"


_SYLLABIC = re.compile(f"(?:{branching(sorted(set(SYLLABLES)))})+")
LATIN = re.compile(f"\\b(?:(?:{branching(sorted(set(SYLLABLES)))})+[\\s,.;]+){{5,}}")

#: Patterns over the text as it is written, with single spaces: (strings of which every match holds one, pattern). A quotation
#: mark before one makes it a mention.
PLACEHOLDERS: list[tuple[list[str], str]] = [
    (["{{"], f"\\{{\\{{(?<![{_QUOTE}]\\{{\\{{)\\s*{_NAME}\\s*\\}}\\}}"),
    (["${"], f"\\$\\{{(?<![{_QUOTE}]\\$\\{{)\\s*{_NAME}\\s*\\}}"),
    (["{"], f"\\{{(?<![{_QUOTE}\\w${{]\\{{)\\s*[A-Za-z]\\w*(?:[ _.]\\w+)*\\s*\\}}(?!\\}})"),
    (["<%"], f"<%(?<![{_QUOTE}]<%)=?\\s*{_NAME}\\s*%>"),
    (["<<"], f"<<(?<![{_QUOTE}]<<)\\s*{_NAME}\\s*>>"),
    (["[["], f"\\[\\[(?<![{_QUOTE}]\\[\\[)\\s*{_NAME}\\s*\\]\\]"),
    (["@@"], f"@@(?<![{_QUOTE}]@@)\\s*{_NAME}\\s*@@"),
    (["__"], f"__(?<![{_QUOTE}\\w]__)\\s*{_NAME}\\s*__(?!\\w)"),
    (["%"], f"%(?<![{_QUOTE}\\w%]%)[A-Za-z]\\w*(?:[ .]\\w+)*%(?!\\w)"),
    (["#"], f"#(?<![{_QUOTE}#\\w]#)[A-Za-z]\\w*(?:[ .]\\w+)*#(?![#\\w])"),
    (["["], f"\\[(?<![{_QUOTE}]\\[)\\s*(?:[Ii]nsert|INSERT|[Ee]nter|ENTER|[Ff]ill in|FILL IN|[Yy]our|YOUR|[Tt]ype|TYPE|[Aa]dd|ADD|[Tt]bd|TBD|[Tt]bc|TBC|[Pp]laceholder|PLACEHOLDER)\\b{_ANY}\\]"),
    (["<"], f"<(?<![{_QUOTE}]<)\\s*(?:[Ii]nsert|INSERT|[Ee]nter|ENTER|[Ff]ill in|FILL IN|[Yy]our|YOUR|[Tt]ype|TYPE|[Aa]dd|ADD|[Pp]laceholder|PLACEHOLDER)\\b{_ANY}>"),
    (["["], f"\\[(?<![{_QUOTE}]\\[)[^\\[\\]\\n]{{1,60}}?\\b(?:to be|TO BE|To be) (?:completed|filled|added|confirmed|supplied|COMPLETED|FILLED|ADDED|CONFIRMED|SUPPLIED)[^\\[\\]\\n]{{0,20}}\\]"),
    (["["], f"\\[(?<![{_QUOTE}]\\[)(?:(?:[A-Z0-9]+[ _/-]){{0,4}}(?:{SLOTS})(?:[ _-]?\\d{{1,2}})?|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\\]"),
    (["<"], f"<(?<![{_QUOTE}]<)(?:(?:[A-Z0-9]+[ _/-]){{1,4}}(?:{SLOTS})(?:[ _-]?\\d{{1,2}})?|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)>"),
    (["«"], "«(?<![\"“”'‘’`]«)[A-Za-z][A-Za-z0-9_.]*(?: [A-Za-z0-9_]+){0,3}»"),
    (["[object O"], "\\[object Object\\]"),
]

#: kind: (strings of which every match holds one, pattern), over lower-cased text with single spaces.
EVIDENCE: dict[str, list[tuple[list[str], str]]] = {
    "script": [
        (["<noscript"], "<noscript"),
        (["script"], "scripts? (?:is|are|has been|appears to be|seems to be) (?:currently )?(?:switched off|turned off|disabled|blocked|not enabled)"),
        (["script"], "(?:enable|activate|allow|turn on|switch on)(?: \\w+){0,2} (?:java)?script(?:s|ing)?\\b(?: \\w+){0,4} (?:to|and|then) (?:see|view|load|reload|open|display|continue|read|use)"),
        (["without script", "without javascript"], "(?:will|does|can) ?not (?:run|work|load|open|display)(?: \\w+){0,3} without (?:java)?script"),
        (["script"], "(?:java)?script(?:s|ing)? (?:is|are|must be) (?:required|needed|enabled|blocked)(?: \\w+){0,3} (?:to (?:see|view|load|open|display|continue|use)|in (?:this|your) browser)"),
        (["script"], "you (?:do not|don['’]t|need to have|must have|have)(?: \\w+){0,2} (?:java)?script(?:s|ing)?(?: is| are)? (?:turned on|switched on|enabled|turned off|disabled)"),
        (["script"], "(?:please|you (?:need|have) to|you must|you['’]ll need to)(?: \\w+)? (?:enable|turn on|activate|allow|switch on)(?: \\w+)? (?:java)?scripts?\\b"),
        (["script"], "(?:this|our|the) (?:site|website|web site|page|web page|app|application|viewer) (?:requires|needs|relies on) (?:java)?script"),
        (["script"], "(?:requires|needs) (?:java)?script(?:s|ing)? (?:to be enabled|enabled|to (?:run|work|function|display))"),
        (["cookie"], "cookies? (?:is|are) (?:missing|blocked|disabled|required)"),
        (["cookies to continue", "cookies and javascript to continue"], "(?:enable|allow|accept) (?:javascript and )?cookies(?: and javascript)? to continue"),
        (["your browser"], "your browser (?:blocks|does not support|doesn['’]t support|has blocked|is not supported|cannot)"),
        (["skript", "script"], "brauch\\w* aktivierte skripte|skripte (?:sind|müssen) (?:deaktiviert|aktiviert)|(?:aktivieren|erlauben) sie (?:java)?s[ck]ripte?"),
        (["script"], "activez (?:les scripts|javascript)|les scripts (?:sont|doivent être) (?:désactivés|activés)"),
        (["script"], "(?:active|habilite|permita) (?:los scripts|javascript)|los scripts están (?:desactivados|bloqueados)"),
        (["スクリプト", "javascript"], "スクリプトを有効|javascriptを有効"),
    ],
    "error": [
        (["traceback ("], "traceback \\(most recent call last\\)"),
        (["<title>", "<h1>"], "<(?:title|h1)>\\s*(?:[45]\\d\\d\\b|error|gateway|forbidden|not found)"),
        (
            ["bad request", "unauthori", "required", "forbidden", "not found", "not allowed", "not acceptable", "timeout", "time-out", "conflict", "gone", "failed", "too large", "too long", "unsupported media", "not satisfiable", "misdirected", "unprocessable", "locked", "failed dependency", "too early", "too many requests", "unavailable", "internal server error", "not implemented", "bad gateway", "not supported", "insufficient storage", "loop detected"],
            f"{_START}(?:http(?:/\\d(?:\\.\\d)?)? )?(?:error |status |code )?[45]\\d\\d(?: error)?(?:[:,]| [-–—|])? (?:{REASONS})\\b",
        ),
        (["http"], f"{_START}http(?:/\\d(?:\\.\\d)?)?(?: (?:error|status))?[ :]+[45]\\d\\d\\b"),
        (["nothing is stored under /"], "nothing is stored under /"),
        (["error 4", "error 5"], "\\berror [45]\\d\\d:"),
        (["service ", "server ", "site ", "host "], "(?:service|server|site|host) (?:did not|does not|didn't|is not) (?:answer|respond|responding|reply)"),
        (["page not ", "page missing", "page was ", "page is ", "page could ", "page can ", "page you "], "page (?:you \\w+ \\w+ \\w+ )?(?:was |is |could |can )?(?:not (?:be )?found|missing)(?: or has \\w+)?\\. (?:the|check|go|return|back|it|path|nothing)"),
        (["you were looking for", "you requested", "you asked for", "you want"], f"{_THING} you (?:were looking for|requested|asked for|want(?:ed)?)[^.]{{0,20}} (?:has|have|is|was|does|could|no longer|cannot)"),
        (["introuvable", "n'existe plus"], "page introuvable\\.? le |le chemin \\S+ n'existe plus"),
        (["nicht gefunden", "vorhanden"], "seite nicht gefunden\\.? der |der pfad \\S+ ist nicht (?:mehr )?vorhanden"),
        (["no encontrada", "ya no existe"], "página no encontrada\\.? la |la ruta \\S+ ya no existe"),
        (["ページが見つかりません", "アクセス"], "ページが見つかりません|アクセスが拒否|アクセスできません"),
        (["access denied", "access refused", "access forbidden", "access is ", "access was "], "access (?:is |was )?(?:denied|refused|forbidden)[.:!]"),
        (["your account"], "your account (?:may|can|does|is) ?not|your account has been (?:suspended|disabled|locked)"),
        (["you do not", "you don't", "you don’t", "you are not"], "you (?:do not|don['’]t|are not) (?:have|allowed|authori[sz]ed|permi\\w+)(?: \\w+){0,3} (?:to (?:open|view|see|access)|permission|access)"),
        (["accès refusé", "acces refus", "accès refus", "acces refusé", "veuillez vous"], "acc[eè]s refusé (?:à|a|\\.|:)|veuillez vous (?:re)?connecter"),
        (["verweigert", "anmelden"], "zugriff verweigert(?: auf|\\.|:)|bitte (?:neu |erneut |wieder )?anmelden"),
        (["denegado", "sesión"], "acceso denegado(?: a|\\.|:)|(?:inicie|vuelva a iniciar) (?:la )?sesión"),
        (["your session", "your login", "your sign-in"], "your (?:session|login|sign-in) (?:has|is) (?:ended|expired|timed out|closed)"),
        (["sign in ", "log in "], "(?:sign|log) in (?:again |first |here )?to (?:view|see|open|continue|read|load|access)"),
        (["you must be signed in", "you must be logged in", "you need to be signed in", "you need to be logged in"], "you (?:must|need to) be (?:signed|logged) in (?:to|before)"),
        (["is down for", "is closed for", "is unavailable for", "is offline for"], "(?:service|site|server|system|viewer) is (?:down|closed|unavailable|offline) for (?:planned|scheduled|urgent) (?:work|maintenance)"),
        (["too many requests."], "too many requests\\."),
        (["you are not a robot", "you are human", "you are a human"], "(?:checking|verify|confirm|prove)(?:ing)? (?:that )?you are (?:not a robot|human|a human)"),
        (["checking your browser", "check your browser", "checking if the site connection"], f"{_START}(?:we are |we're )?(?:checking (?:your browser|if the site connection)|(?:we )?need to check your browser)"),
        (["security check", "captcha"], "(?:please |you must |you need to |to continue,? )(?:complete|solve|pass) (?:the|this|a) (?:security check|captcha)"),
        (["security of your connection", "ray id:", "ddos protection by"], "(?:needs to|is|must) (?:review|reviewing) the security of your connection|ray id: [0-9a-f]{6}|ddos protection by "),
        (["traffic from your"], "(?:unusual|automated|suspicious) traffic from your (?:computer|network|address|ip)"),
        (["just a moment", "one moment", "please wait"], f"{_START}(?:just a moment|one moment|please wait)[.,…! ]+(?:while )?(?:we|your browser|you)(?: \\w+){{0,2}} (?:check|verif|redirect|review)\\w*"),
        (
            ["could not ", "couldn't ", "cannot ", "can't ", "unable to ", "failed to "],
            "(?:could not|couldn't|cannot|can't|unable to|failed to) (?:convert|render|display|load|open|preview|show) (?:this|the|your)? ?(?:file|document|drawing|sheet|page|/\\S+)",
        ),
        (["loading viewer", "loading document", "loading drawing", "loading page", "loading content"], "loading (?:viewer|document|drawing|page|content)(?:…|\\.\\.\\.)"),
        (["keyerror: '"], "keyerror: '"),
        (["whoops", "oops", "sorry", "uh-oh", "hoppla"], f"{_START}(?:whoops|oops|sorry|uh-oh|hoppla)[,.!… ]+(?:(?:it )?looks like |it seems |but )?(?:something went wrong|an error|there was an? (?:error|problem)|we (?:can['’]t|cannot|could ?n['’o]t|are unable)|(?:the|this|that) (?:page|site|document|link)|page not found|your request)"),
        (["something went wrong", "something has gone wrong"], f"{_START}(?:it looks like |it seems that )?something (?:went|has gone) wrong(?:[.!]|$| (?:while|on our|and we|please|try))"),
        (["error occurred", "error has occurred", "exception occurred", "exception has occurred"], f"{_START}an? (?:unexpected|internal|unknown|unhandled|application|server|runtime) (?:error|exception) (?:has )?occurred(?:[.!]|$| (?:while|please|and your|on the server))"),
        (["processing your request"], "(?:error|problem|exception) (?:has )?(?:occurred )?(?:while |when |in )?processing your request"),
        (["err_", "dns_probe_"], "\\b(?:err_(?:connection|name|empty|internet|ssl|cert|address|timed|too_many|network|failed|invalid|http2?|blocked|proxy|tunnel|response|content|access|file|unknown|cache|unsafe|aborted|socket|dns)[a-z_]*|dns_probe_\\w+)\\b"),
        (["send any data", "refused to connect", "too long to respond", "unable to handle this request", "be reached"], "(?:didn['’]t|did not) send any data|\\S+\\.\\S+ refused to connect|took too long to respond|is currently unable to handle this request|this (?:site|page|webpage|website) (?:can['’]t|cannot|could not) be reached"),
        (["working", "displayed", "available"], f"{_START}(?:sorry, )?(?:this|the requested) (?:site|page|webpage|website|content|document|video|resource) (?:isn['’]t|is not|is no longer|can['’]t be|cannot be) (?:working|displayed|available)(?:[.!]|$| (?:in your|to you|right now|at this time|at the moment|because|check|try|please))"),
        (["reference source not", "bookmark not", "hyperlink reference not"], "error! (?:reference source|bookmark|hyperlink reference) not (?:found|defined|valid)"),
        (["welcome to nginx", "apache server at", "this domain "], "welcome to nginx!|apache server at \\S+ port \\d|this domain (?:is parked|is for sale|has expired|may be for sale)"),
        (["status code", "fatal error", "stack trace", "unhandled"], "request failed with status code [45]\\d\\d|fatal error: uncaught|unhandled (?:exception|rejection)[:.]"),
    ],
    "filler": [
        (["lorem ipsum"], "(?<!such as )(?<!like )(?<!as in )(?<![\"“'])lorem ipsum(?! (?:must|is|was|should|and|or|text|may|in|on|at|to|has|can)\\b)"),
        (["asdf"], "\\basdf\\w*\\b.{0,30}\\bqwer|\\bqwertz?y?\\b.{0,20}\\basdf"),
        (["test"], "(?:\\btest\\b[ ,.]*){3,}"),
        (["blah", "filler", "text", "more", "dummy", "sample"], "(?:\\b(?:blah|filler|text|more|dummy|sample)\\b[ ,.]*){6,}|(?:blah[ ,.]*){3,}"),
        ([" goes here"], "(?:text|content|copy|description|paragraph|body|title|heading|name|image) goes here"),
        (["to be replaced"], "sample (?:paragraph|text|content)[^.]{0,10} to be replaced"),
        (["dummy "], "dummy (?:text|content|copy) for (?:layout|design|test)"),
        (["in this "], "(?:insert|write|enter|type|describe|add|give)\\b[^.]{3,80} in this (?:space|box|field|section|place)\\b"),
        (["a stub", "a placeholder"], "(?:section|page|paragraph|chapter|document) is (?:intentionally |deliberately )?(?:a stub|left as a stub|a placeholder)"),
        (["content "], "content (?:will follow|to follow|to come|coming soon)\\b[. ]*(?:\\(draft|$)"),
        (["xxx"], "(?:\\bx{3,}\\b[ .,/-]*){3,}"),
        (["here to enter", "here to add", "here to insert"], "(?:click|tap)(?: or tap)? here to (?:enter|add|insert) (?:text|a (?:date|title|caption|note)|title|content)"),
        (["choose an item."], "(?:^|[.:|] )choose an item\\."),
        (["placeholder text", "sample text", "dummy text"], f"{_START}this is (?:just |only )?(?:a |some )?(?:sample|placeholder|dummy) text\\b"),
        (["tbd", "tbc", "todo", "fixme"], "\\b(?:tbd|tbc|todo|fixme)\\b ?(?:[-–—:]|\\() ?(?:to be|add|write|insert|fill in|fill|complete|describe)\\b"),
    ],
}

_LINE = re.compile("[\n\r\x0b\x0c\x85\u2028\u2029]+")
_HYPHENED = re.compile("(?<=[^\\W\\d_])[-‐‑¬\xad]\\s*[\n\r\x0b\x0c\x85\u2028\u2029]\\s*(?=[^\\W\\d_])(?=[^A-Z])")
_WORD = re.compile("[^\\W\\d_]+")
_BARE = re.compile("\\W*(?:(?:(?:http|error|status|code)\\W*)+[45]\\d\\d|403|404|500|502|503)\\W*")


def flow(text: str) -> str:
    """Lines as running text: words cut at line ends joined, white space single."""
    return " ".join(_HYPHENED.sub("", text).replace("\u200b", " ").replace("\ufeff", " ").split())


class Finder:
    """All patterns behind one automaton over their plain strings."""

    def __init__(self) -> None:
        import ahocorasick

        self.patterns = [("placeholder", re.compile(p)) for _, p in PLACEHOLDERS] + [(k, re.compile(p)) for k, signs in EVIDENCE.items() for _, p in signs]
        hints = [h for h, _ in PLACEHOLDERS] + [h for signs in EVIDENCE.values() for h, _ in signs]
        by: dict[str, list[int]] = {}
        for n, strings in enumerate(hints):
            for s in strings:
                by.setdefault(s.lower(), []).append(n)
        self.automaton = ahocorasick.Automaton()
        for s, ns in by.items():
            self.automaton.add_word(s, tuple(ns))
        self.automaton.make_automaton()
        self.latin: dict[str, int] = {}

    def _is_latin(self, word: str) -> int:
        """1: made of the syllables; 2: one of the words."""
        if len(self.latin) > 200_000:
            self.latin.clear()
        kind = self.latin[word] = 2 if word in LATIN_WORDS else 1 if _SYLLABIC.fullmatch(word) else 0
        return kind

    def filler(self, low: str) -> bool:
        """Five syllabic words in a row, or six words of the passages of which four are different longer ones."""
        run: list[str] = []
        known = self.latin
        for w in [*_WORD.findall(low), "|"]:
            kind = known.get(w)
            if kind is None:
                kind = self._is_latin(w)
            if kind:
                run.append(w)
            elif run:
                if len(run) >= 6 and len({x for x in run if len(x) > 3 and x in LATIN_WORDS}) >= 4:
                    return True
                if len(run) >= 5 and LATIN.search(low):
                    return True
                run = []
        return False

    def kinds(self, text: str) -> set[str]:
        """The kinds of evidence in a text."""
        t = flow(text)
        low = t.lower()
        hit = set()
        for _, ns in self.automaton.iter(low):
            hit.update(ns)
        out = set()
        for n in sorted(hit):
            kind, pattern = self.patterns[n]
            if kind not in out and pattern.search(t if kind == "placeholder" else low):
                out.add(kind)
        if "filler" not in out and self.filler(low):
            out.add("filler")
        if len(low) < 40 and _BARE.fullmatch(low):
            out.add("error")
        return out

    def judged(self, text: str, gone: list[int] | None) -> set[str]:
        """The kinds of evidence of a document; ``gone`` are the numbers of its lines that are boilerplate."""
        out = self.kinds(text)
        if gone and out & {"error", "script"}:
            left = set(gone)
            rest = "\n".join(x for n, x in enumerate(_LINE.split(text)) if n not in left)
            if len(flow(rest)) >= RESIDUE:
                out = (out & {"placeholder", "filler"}) | (self.kinds(rest) & {"error", "script"})
        return out


@lru_cache
def finder() -> Finder:
    return Finder()


def _lines(text: Column) -> Column:
    return F.split(text, f"[{T.LINE_BREAKS}]+")


def _shape(line: Column) -> Column:
    """A line in lower case with single spaces, trimmed; hashed."""
    return F.xxhash64(F.lower(F.regexp_replace(F.trim(line), "\\s{2,}", " ")))


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, host, n, line) of the lines that aren't blank: number and hash."""
    lines = docs.select("doc_id", "host", F.posexplode(_lines(F.col("text"))).alias("n", "l"))
    return lines.where(F.col("l").rlike("\\S")).select("doc_id", "host", "n", _shape(F.col("l")).alias("line"))


def boilerplate(docs: DataFrame) -> DataFrame:
    """(host, line): hashes of the recurrent lines of each host over its distinct texts."""
    copies = docs.select("doc_id", "host", F.xxhash64("text").alias("copy"), F.xxhash64(F.lit(1), "text").alias("copy2"))
    first = copies.groupBy("host", "copy", "copy2").agg(F.min("doc_id").alias("first"), F.count("*").alias("c"))
    totals = first.groupBy("host").agg(F.count("*").alias("texts"))
    later = copies.join(small(cut(first.where("c > 1").select("host", "copy", "copy2", "first"))), ["host", "copy", "copy2"]).where("doc_id <> first").select("doc_id")
    once = _numbered(docs.join(small(cut(later)), "doc_id", "left_anti")).select("doc_id", "host", "line")
    # a line counts once for each text; the first aggregation is by text, so it ends where the text is read
    seen = once.groupBy("doc_id", "host", "line").agg(F.lit(1).alias("o")).groupBy("host", "line").agg(F.count("*").alias("n"))
    p, z = F.col("n") / F.col("texts"), F.lit(SURE)
    spread = z * F.sqrt(p * (1 - p) / F.col("texts") + z * z / (4 * F.col("texts") * F.col("texts")))
    low = (p + z * z / (2 * F.col("texts")) - spread) / (1 + z * z / F.col("texts"))
    return seen.join(F.broadcast(totals) if totals.limit(10_001).count() <= 10_000 else totals, "host").where(low > SHARE).select("host", "line")


def evidence(documents: DataFrame, host_col: str = "domain") -> DataFrame:
    """(doc_id, kind) of each document with evidence: placeholder, filler, error or script."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.trim(F.lower(F.col(host_col))), F.lit("")).alias("host"), "text").where("text is not null and doc_id is not null")
    often = cut(boilerplate(docs))
    gone = F.lit(None).cast("array<int>")
    if often.isEmpty():
        held = docs.select("doc_id", "text", gone.alias("gone"))
    else:
        hits = _numbered(docs).join(small(often), ["host", "line"], "left_semi").groupBy("doc_id").agg(F.collect_set("n").alias("gone"))
        held = docs.join(small(cut(hits)), "doc_id", "left").select("doc_id", "text", "gone")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for b in batches:
            ids, kinds = [], []
            for i, t, g in zip(*(c.to_pylist() for c in b.columns)):
                for k in sorted(find.judged(t, g)):
                    ids.append(i)
                    kinds.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string())], names=["doc_id", "kind"])

    return held.mapInArrow(work, "doc_id long, kind string").distinct()


def found(documents: DataFrame) -> DataFrame:
    """doc_id of the documents to be kept out."""
    return evidence(documents).select("doc_id").distinct()


def kept(documents: DataFrame) -> DataFrame:
    """The documents without evidence."""
    out = cut(found(documents))
    return documents.join(small(out), "doc_id", "left_anti")
