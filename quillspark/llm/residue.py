"""Template residue and error-page text.

A record is excluded if it shows an error page, a browser check, a notice that scripts are needed, filler text or
an unfilled slot instead of its content.  All normalised lines are counted by host, each text once; lines that
recur in a large part of the host's texts are its boilerplate and are subtracted from every record that holds
other prose besides.  What is left is judged line by line against a small grammar of system messages (who speaks,
what failed, status numbers, imperative and script word), not against whole sentences.

Evidence of an error, a check or a script notice must close the record: prose that goes on after it shows that
the line is part of the page and not what replaced the story.  Slots and filler count wherever they stand, and are
never subtracted, as a template copied into many records is unfilled in each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import saved

# What slots and filler look like.  Lines are normalised before: white space runs are one blank, no
# blank at either end.
FIELD = r"(?:name|project|reward|tier|delivery|date|goal|price|city|company|creator|headline|heading|product|shipping|cost|stretch|team|bio|video|link|story|risks?|section|backer|title|text|image|photo|amount|country|email|url|logo|number|quantity|deadline|description|content|brand|paragraph|tagline|address)"
PERSONAL = r"(?i:name|amount|date|price|city|company|country|e-?mail|address|number|quantity|deadline|title|tagline|headline|currency|percentage|surname|username|phone|occupation|industry)"
SLOTS = [
    r"\{\{ ?[A-Za-z][\w .]{0,40}?\}\}", r"\{%=? ?[A-Za-z][\w .]{0,40}?%\}", r"<%=? ?[A-Za-z][\w .]{0,60}?%>",
    r"[#$]\{[A-Za-z]\w{0,40}\}", r"%%[A-Za-z]\w{0,40}%%", r"%[A-Z][A-Z_]{2,40}%", r"@@[A-Za-z]\w{0,40}@@",
    r"(?<!\w)__[A-Z][A-Z_]{0,40}__", r"\[\[[A-Za-z][\w ]{0,40}\]\]", r"\[(?i:insert|add|enter) [^\]\n]{1,60}(?i:here)?\]", r"\[(?:Your|YOUR) [^\]\n]{1,60}\]",
    rf"\[(?:[A-Z][\w'’]{{0,20}} ){{0,3}}(?<=[\[ ])(?=[A-Z]){PERSONAL}\]",
    r"\[[^\]\n]{1,60} – to be added\]", r"\bTODO: [A-Za-z{\[<%$@_«(]", rf"\((?i:insert) [\w ]{{0,30}}(?i:{FIELD})[\w ]{{0,10}} (?i:here)\)",
    r"«[A-Z][A-Z_ ]{2,40}»", r"(?<![\w<])<(?!(?:p|br|hr|b|i|u|a|em|strong|div|span|li|ul|ol|img|table|tr|td|th|code|pre|script|style|html|body|head|noscript|center|blockquote)>)[a-z]+(?:[_ ][a-z]+){0,3}>", r"(?<![\w{$#])\{[a-z]+(?:_[a-z]+){0,3}\}",
]
SLOT_SIGNS = ["{", "[", "%", "@@", "«", "<", "__", "TODO: ", "(insert ", "(Insert "]  # one of them is in every slot
MENTION = r"\b(?:such[ \n]as|(?:tags?|placeholders?|variables?|tokens?)(?:[ \n](?:like|called|named))?)[ \n][\"'“‘`]?"
LATIN = "lorem|ipsum|dolor|sit|amet|consequat|consectetur|adipiscing|elit|sed|eiusmod|tempor|incididunt|ut|labore|et|dolore|magna|aliqua|enim|minim|veniam|quis|nostrud|laboris|nisi|aliquip|commodo|velit|cillum|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidat|cupidatat|culpa|officia|deserunt|mollit|anim|laborum"
MASH = "asdf|qwer|zxcv|hjkl|poiu|dfgh|xxx|bla|blah|placeholder|platzhalter|blindtext|beispieltext|filler|text|test"


def _trie(words: str) -> str:
    """An alternation of words factored by their beginnings, each also with a capital."""

    def build(ws: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for w in ws:
            heads.setdefault(w[:1], []).append(w[1:])
        return "(?:" + "|".join(h + (build(t) if h and any(t) else "") for h, t in sorted(heads.items(), reverse=True)) + ")"

    heads: dict[str, list[str]] = {}
    for w in words.split("|"):
        heads.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"[{h.upper()}{h}]{build(t)}" for h, t in sorted(heads.items())) + ")"


_GAP = r"[ ,.;:!?\n]+"
_LATIN, _MASH = _trie(LATIN), _trie(MASH)
# three words of mash, five of Latin, after a character that isn't part of a word
FILLER = rf"\W(?:{_MASH}\b(?:{_GAP}{_MASH}\b){{2}}|{_LATIN}\b(?:{_GAP}{_LATIN}\b){{4}})"

# ---- the grammar of system messages: classes of words, then lines made of them (case doesn't matter)
_END = r"(?: ?[.!?:;,…–-].{0,160})?"  # further sentences of the same message
_ON = r"(?:[ ,.!:;–-].{0,120})?"  # or it simply goes on
_NOT = r"(?: ?not|n?['’]t)"
_HUSH = r"(?:[1-5]\d\d ?[.:,–-]+ )?(?:(?:oops|whoops|hmm|sorry|uh-oh|oh no|error|warning|notice|attention|alert|unfortunately|we['’]re sorry|we are sorry)[.!,:…–-]* (?:but )?)?"
_DET = r"(?:the|this|that|your|our|an?) "
_KINDS = r"(?:(?:web|campaign|requested|home|origin|remote|database|upstream|network)[ -]?){0,2}"
_SYSTEM = rf"(?:{_DET})?{_KINDS}(?:page|pages|(?:web ?)?site|servers?|url|address|resource|file|document|link|request|connection|database|host|session|gateway|domain|proxy)"
_OFFER = rf"(?:the|this|that) (?:requested )?(?:project|campaign(?: page)?|content|app|video|story|account)"
_ASKED = r"(?: (?:that )?(?:you|we)(?:['’](?:re|ve|d))?(?: (?:are|were|have))? (?:requested|asked for|look(?:ed|ing) for|tr(?:ied|ying) to (?:access|reach|open|view|visit)|visit(?:ed|ing)|followed|entered|typed)| at this address| on this server| [0-9a-f]{5,40})?"
_DONE = r"(?:found|reached?|displayed|shown|loaded?|opened|completed?|processed|exist|respond(?:ing)?|available|accessible|served|established?|resolved?|connected|working|authori[sz]ed|permitted|handled|fulfilled|verified)"
_FAILS = rf"(?:(?:(?:could|can|did|does|was|is|were|are|has|have){_NOT}|cannot|failed to) (?:currently )?(?:be |been )?{_DONE}|(?:is|are|was|were|has been|have been|seems to be|appears to be|might be|may be|is being) (?:currently |temporarily |no longer |not |now |being |briefly )*(?:down|unavailable|offline|under maintenance|undergoing maintenance|over capacity|overloaded|blocked|expired|forbidden|refused|reset|timed out|interrupted|missing|rate[ -]limited|denied|rejected|available|found|terminated)|(?:has|have) (?:moved|expired|timed out|encountered an? .{{0,30}}(?:error|problem))|(?:has |have )?(?:timed out|expired)|no longer exists?|took too long.{{0,30}}|refused to connect)(?: or no longer exists?)?(?: (?:for|due to|because of|by|on|at|from|right|in) .{{1,80}})?"
_GONE = rf"(?:is no longer available|no longer exists?|(?:could|can){_NOT} be (?:found|displayed|shown|loaded)|cannot be (?:found|displayed|shown|loaded)|does{_NOT} exist|has been removed)"
# The reasons that servers give with a status number, in five languages.
REASONS = ["bad request", "unauthorized", "payment required", "forbidden", "not found", "page not found", "method not allowed", "not acceptable", "access denied", "permission denied", "request time-?out", "a timeout occurred", "conflict", "gone", "precondition failed", "payload too large", "too many requests", "you are being rate limited", "unknown error", "internal server error", "server error", "not implemented", "bad gateway", "service (?:temporarily )?unavailable", "gateway time-?out", "connection timed out", "origin is unreachable", "web server is down"]
FOREIGN = ["acceso denegado", "p[áÁ]gina no encontrada", "demasiadas solicitudes", "error interno(?: del servidor)?", "servicio no disponible", "page introuvable", "service indisponible", "acc[èÈ]s refus[éÉ]", "erreur interne(?: du serveur)?", "trop de requ[êÊ]tes", "interner serverfehler", "seite nicht gefunden", "zugriff verweigert", "zu viele anfragen", "dienst nicht verf[üÜ]gbar"]
_REASON = "(?:" + "|".join(REASONS + FOREIGN) + ")"
_NUM = r"[1-5]\d\d\d?"
_SYS = r"(?:http(?:/[\d.]+)?|status|error|code|err|fehler(?:code)?|erreur|c[óÓ]digo|upstream|returned|response|server)"
_CODE = r"[0-9a-f][0-9a-f.-]{3,40}"
_S = r"(?:java ?script|active scripting|scripts?|scripting)(?:,? (?:and|or|&) (?:browser )?cookies)?"
_S = rf"(?:cookies and )?{_S}"
_PAGE = r"(?:(?:this|the|our|your) (?:web ?)?(?:page|site|website|app|application|campaign|content|video|browser|form|comments?)|you|[\w-]+\.[\w.]+)"
_PROOF = r"(?:human|not a (?:ro)?bot|(?:a|real) (?:real )?person|captcha|your browser|your connection|site connection|automated (?:visit|access|request)|security of your|not automated)"

LINES = {
    "error": [
        rf"{_SYSTEM}{_ASKED} {_FAILS}{_END}", rf"{_OFFER} {_GONE}{_END}",
        rf"(?:{_SYS}[ :#–-]*){{1,4}}{_NUM}(?: ?[:–-] ?.{{1,80}}| {_REASON})?[.!]?", rf"{_NUM}(?: ?[:–-])? ?{_REASON}{_END}", rf"(?-i:(?=[A-Z])(?!(?:Forbidden|Unauthorized|Gone|Conflict)[.!]?$)){_REASON}[.!]?", rf"{_REASON} ?[(\[–:-] ?(?:{_SYS} ?)?{_NUM}[)\]]?[.!]?",
        rf"(?:(?:you|your (?:ip|access|request|connection|account)(?: address)?|access|request)(?: to .{{1,40}}?)?(?: (?:have|has|is|was|are|were)(?: been| being)?(?: temporarily)?)? (?:denied|blocked|rejected|refused|rate[ -]limited|banned|restricted|throttled)){_END}",
        rf"(?:you )?(?:do{_NOT}|no longer) have (?:the )?(?:permissions?|access|authori[sz]ation) to .{{1,100}}",
        rf"(?:rate limit exceeded|too many (?:requests|attempts|connections)(?: .{{1,60}})?|limit: \d+ per \w+|retry after \d+ \w+|(?:you are|you['’]re) (?:going|sending|making|browsing|requesting|clicking) .{{0,30}}(?:too fast|too quickly|too many .{{1,20}})|slow down and .{{1,30}}|(?:we (?:have )?detected )?unusual (?:traffic|activity) .{{1,80}}){_END}",
        rf"(?:an? )?(?:(?:unexpected|unknown|internal|fatal|server|application|critical|unhandled|database|network|php|sql) )*(?:error|exception|problem)(?: has| was)? (?:occurred|happened|encountered|raised|thrown){_ON}", rf"(?:something|things|it) (?:went|has gone|have gone) wrong{_ON}",
        rf"we hit a (?:snag|problem|bump){_END}", rf"our (?:engineers|team|developers|administrators?)(?: ha(?:s|ve)| are| is)? (?:been )?(?:notified|alerted|informed|working on (?:it|a fix|this)){_END}",
        rf"(?:we|it looks like we|it seems we|we are|we were) (?:could{_NOT}|can{_NOT}|cannot|are unable to|were unable to|failed to|unable to) (?:find|load|reach|process|display|complete|open|connect to|locate|show) (?:(?:that|this|the|your|what) ?)?(?:(?:page|site|request|url|address|server|project|file|content){_ASKED}|you .{{1,40}})?{_END}",
        rf"there(?: is|['’]s) nothing (?:here|at this address|to see here){_END}",
        rf"(?:error|failed|failure|unable|could{_NOT}|cannot|can['’]t)(?: to)? (?:establish|connect|load|open|process|resolv|fetch|execut|pars|render)(?:e|ing)?(?: to)? .{{1,80}}",
        r"traceback\b.{1,80}", r"(?:uncaught |fatal |unhandled )(?:error|exception)\b.{0,80}", r"upstream (?:returned|sent|connect) .{1,60}",
        r"se ha producido un error\b.{0,80}", r"une erreur (?:est survenue|s['’]est produite)\b.{0,80}", r"es ist ein fehler aufgetreten\b.{0,80}", r"(?:ocurri[óÓ] un error|algo sali[óÓ] mal)\b.{0,80}",
        r".{0,20}(?:エラーが発生しました|ページが見つかりません|アクセスが拒否されました|アクセスできません|しばらくしてから).{0,60}", r"(?:\d{3} )?エラー ?\d{0,4}.{0,40}",
    ],
    "browser_check": [
        rf"(?:we are |we['’]re |now )?(?:checking|verifying|confirming|reviewing|validating) (?:if |that |whether )?.{{0,40}}(?:{_PROOF}|secure\b|you are\b).{{0,100}}",
        rf"(?:please )?(?:verify|confirm|prove|show us)(?: that)? (?:you(?:['’]re| are)|your are) (?:human|not a (?:ro)?bot|a (?:real )?(?:person|human))\b.{{0,100}}",
        rf"(?:we|the server|(?:this|the|our) (?:web ?)?(?:site|page)|[\w-]+\.[\w.]+) (?:need|want|have|must|needs|wants|has)(?: to)? (?:check|confirm|review|verify|validate|make sure) .{{0,60}}\b{_PROOF}\b.{{0,120}}",
        r"(?:please )?(?:slide|press|press and hold|hold|tick|check|click|drag|select|type|solve|complete|enter|match)\b.{0,70}\b(?:human|not a (?:ro)?bot|captcha|press verify|puzzle and unlock the page|characters (?:you see|shown)|security check)\b.{0,60}",
        r"(?:are you (?:a )?(?:human|robot)|i(?:['’]m| am) not a robot|not a bot)\b.{0,80}",
        rf"(?:ddos|bot) protection by .{{1,40}}", r"session [0-9a-f]{6,40} expired[.!]?", r".{0,20}(?:ブラウザを?(?:確認|チェック)|ロボットではない).{0,60}",
    ],
    "script_notice": [
        rf"(?:please |kindly |you(?:['’]ll)? (?:must|need to|have to|should) |to [^,.]{{1,60}}, )*(?:re-?)?(?:enable|activate|allow|turn on|switch on|permit|use a browser with|install) {_S}{_ON}",
        rf"(?:please |kindly |you (?:must|need to|have to) )*(?:turn|switch) {_S} (?:back )?on{_ON}",
        rf"{_S} (?:(?:is|are|must be|has to be|have to be|needs? to be|should be|seems? to be|appears? to be|(?:is|are) currently|may be) )?(?:disabled|blocked|turned off|switched off|off|required|enabled|needed|not (?:enabled|supported|available|running)){_ON}",
        rf"{_PAGE} (?:requires?|needs?|depends on|relies on|(?:(?:does|will|can|could|do){_NOT}|cannot) (?:work|be shown|be displayed|run|load|function|be used)(?: properly| correctly)? without|(?:does|do){_NOT} (?:seem to )?(?:support|allow|run)|has disabled|(?:has|have) blocked|must have) {_S}{_ON}",
        rf".{{0,60}}(?:does{_NOT}|cannot|can['’]t|won['’]t|will not) work (?:properly |correctly )?without {_S}{_ON}",
        r"(?:bitte )?(?:aktivieren|aktiviere|erlauben|erlaube|schalten)(?: sie)?(?: bitte)? javascript\b.{0,80}", r"javascript (?:ist|muss) .{0,40}(?:deaktiviert|aktiviert|ausgeschaltet|eingeschaltet).{0,60}",
        r"(?:veuillez )?(?:activer|autoriser|activez|autorisez) (?:le )?javascript\b.{0,80}", r"(?:por favor,? )?(?:active|activa|habilite|habilita|permita) javascript\b.{0,80}", r".{0,30}javascript ?(?:を|が|の).{0,60}",
    ],
    "filler": [
        rf"(?:sample|dummy|placeholder|example|filler) (?:text|copy|title|heading|content)\b.{{0,80}}", r"this is (?:a )?(?:dummy|sample|placeholder|filler|example) (?:copy|text|paragraph)\b.{0,80}",
        rf"(?:replace|overwrite|edit|change) this (?:block|section|text|paragraph|content|placeholder)\b.{{0,60}}", r"(?:body copy|(?:your )?text|more text|story) to follow\..{0,60}", r"caption for image \d+",
        r"click (?:here )?to (?:edit|add|change) (?:this |a |your )?(?:text|paragraph|heading|title|content)\b.{0,40}", rf"(?:your |the |project )?(?:sub)?{FIELD}(?: text)? goes here{_END}",
        rf"(?:please )?(?:insert|enter|type|write|put|paste|place|add) (?:your|a|an|the|some|more) (?:own |short |project |brief |company |campaign )?{FIELD}(?: text| copy)? (?:here|in this box|below){_END}",
        rf"(?:describe|explain) the [\w ]{{1,40}} of your project in this box{_END}", r"write (?:a few sentences|[\w]+ (?:paragraphs?|words|sentences)) about your [\w ]{1,20} here\.",
        r"(?:t[íÍ]tulo|texto|p[áÁ]rrafo) de ejemplo\b.{0,80}", r"(?:sustituya|cambie|reemplace) este p[áÁ]rrafo\b.{0,60}", r"(?:inserte|escriba) (?:aqu[íÍ] )?su (?:texto|historia|t[íÍ]tulo)\b.{0,60}",
        r"votre (?:histoire|titre|texte|paragraphe) ici\b.{0,80}", r"(?:modifiez|remplacez) ce paragraphe\b.{0,60}", r"(?:texte|titre) d['’]exemple\b.{0,80}", r"(?:ins[ée]rez|[ée]crivez) votre (?:texte|histoire|titre) ici\b.{0,60}",
        r"hier (?:steht|kommt|folgt) (?:sp[äÄ]ter |noch |bald )?(?:ihr|dein) (?:text|titel)\b.{0,80}", r"bitte (?:anpassen|[üÜ]berschreiben|ersetzen)\.", r"(?:f[üÜ]gen|geben) sie (?:hier )?ihren (?:text|titel) .{0,40}",
        r"ここに.{0,20}(?:入力|記入|記載|書い)して?ください。?", r".{0,10}(?:サンプル|ダミー)(?:テキスト|文章|の文).{0,40}",
    ],
    # one word alone: weak, as it can be a title too
    "weak": [r"(?-i:Forbidden|Unauthorized|Gone|Conflict)[.!]?"],
    # what stands beside the message, and says little alone
    "support": [
        r"(?:just a moment|one moment|please wait|hold on(?: a second)?|attention required|security check|loading|redirecting|access check)(?:, please|, please wait)?[.!?…]*", r"noscript", r"supported browsers", r"why am i seeing this\?",
        rf"(?:(?:please |kindly )?(?:try again|refresh|reload|come back|check back|check again|go back|return)\b.{{0,60}}(?:later|soon|minutes?|moments?|shortly|again|page)){_END}", rf"if th(?:is|e) (?:keeps|problem|error|issue) .{{1,60}}", rf"check the (?:address|url|spelling) .{{1,60}}",
        rf"(?:incident|trace|request|ray|event|error|correlation|support|request reference|reference)(?: (?:id|reference|number))?[ :#]*{_CODE}\.?",
        r"(?:[a-z]+(?:-[a-z]+)?/\d[\d.]*|nginx|apache|httpd|openresty|varnish|cloudflare|iis|caddy)", r"(?:contact|email|write to|call) (?:the )?(?:site )?(?:support|administrator|owner|webmaster)\b.{0,60}",
    ],
}
_CLASS = {"error": "E", "browser_check": "C", "script_notice": "S", "filler": "F", "weak": "w", "support": "s"}

_ODD = r"\t\x0B\f\r\u00A0\u1680\u2000-\u200B\u202F\u205F\u3000\uFEFF"
SPACES = rf"[{_ODD}][{_ODD} ]*| [{_ODD} ]+"
_SLOT = "|".join(SLOTS)


def _any(text: Column, signs: list[str]) -> Column:
    out = F.lit(False)
    for s in signs:
        out = out | text.contains(s)
    return out


def _wide(text: Column) -> Column:
    """Whether the text holds more than ASCII."""
    return F.octet_length(text) != F.length(text)


def normalised(text: Column) -> Column:
    """White space runs (line ends kept) are one blank, lines are trimmed."""
    odd = _any(text, ["  ", " \n", "\n ", "\t", "\r", "\x0b", "\f"]) | (_wide(text) & text.rlike(rf"[^\x00-\x7F](?<=[{_ODD}])"))  # most texts need no change
    return F.when(odd, F.regexp_replace(F.regexp_replace(text, SPACES, " "), r" ?\n ?", "\n")).otherwise(text)


def _whole(patterns: list[str], many: bool) -> str:
    return ("(?im)" if many else "(?i)") + f"^ ?{_HUSH}(?:" + "|".join(f"(?:{p})" for p in patterns) + ") ?$"


_JAPANESE = [p for ps in LINES.values() for p in ps if any("\u3000" < c for c in p)]
_SCRIPTS = [p for p in LINES["script_notice"] if p not in _JAPANESE]
_OTHERS = [p for ps in LINES.values() for p in ps if p not in _JAPANESE and p not in _SCRIPTS]


def may_show(text: Column) -> Column:
    """Whether a line of the text is of a system message; what only some texts can hold is looked for in those alone."""
    scripts = _any(text, ["cript", "CRIPT"]) & text.rlike(_whole(_SCRIPTS, True))
    return scripts | (_wide(text) & text.rlike(_whole(_JAPANESE, True))) | text.rlike(_whole(_OTHERS, True))


def slot_lines(text: Column) -> Column:
    """The lines of a normalised text that hold an unfilled slot, digits as 9; slots that are only spoken of
    (after "such as", "called" and the like) don't count."""
    bare = F.regexp_replace(text, rf"(?i:{MENTION})(?:{_SLOT})", "such as")
    hits = F.regexp_extract_all(bare, F.lit(rf"(?m)^(.*?(?:{_SLOT}).*)$"), F.lit(1))
    return F.array_distinct(F.transform(hits, lambda x: F.regexp_replace(x, r"\d+", "9")))


def line_class(line: Column) -> Column:
    """One letter: E error, C browser check, S script notice, F filler, w a reason alone, s what stands beside a
    message, p prose (12 words, or 60 characters of wide script), o anything else."""
    out = F.when((F.size(F.split(line, " ")) >= 12) | (_wide(line) & (F.octet_length(line) >= 2.5 * F.length(line)) & (F.length(line) >= 30)), "p").otherwise("o")
    for kind in reversed(list(LINES)):
        out = F.when(line.rlike(_whole(LINES[kind], False)), _CLASS[kind]).otherwise(out)
    return out


def line_hashes(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda s: F.xxhash64(s))


def boilerplate(lines: DataFrame, min_share: float, z: float = 3.29) -> DataFrame:
    """_host and _boiler, the hashes of the lines that recur in at least `min_share` of the host's different texts.

    `lines` has a row for each different text (_host, _text) with its line hashes.  The share is held against its
    lower limit of confidence, so that the few texts of a small host prove little; a line of one text alone never
    recurs.  At most (lines a text) / min_share lines of a host can pass.
    """
    each = lines.select("_host", F.explode(F.array_distinct("_hashes")).alias("_h")).groupBy("_host", "_h").agg(F.count("*").alias("_k")).filter("_k >= 2")
    sizes = lines.groupBy("_host").agg(F.count("*").alias("_n")).select(F.col("_host").alias("_of"), "_n")
    k, n = F.col("_k").cast("double"), F.col("_n").cast("double")
    p = k / n
    lower = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    often = each.join(sizes, F.col("_host").eqNullSafe(F.col("_of"))).filter(lower >= min_share)
    return often.groupBy("_host").agg(F.collect_list("_h").alias("_boiler")).select(F.col("_host").alias("_of"), "_boiler")


def judged(lines: Column, boiler: Column, flagged: Column) -> Column:
    """The kind that the lines (structs of hash h and class c) show, or null.

    Boilerplate goes where prose is left besides; then strong evidence must not be followed by prose, and what is
    weak alone (a bare reason, words that stand beside a message) counts only where the record holds no prose and at
    most one line of another kind, or where it closes a record that the crawler flagged.
    """
    left = F.filter(lines, lambda x: ~F.array_contains(boiler, x["h"]))
    use = F.when(boiler.isNotNull() & F.exists(left, lambda x: x["c"] == "p"), left).otherwise(lines)
    s = F.array_join(F.transform(use, lambda x: x["c"]), "")
    last = F.regexp_extract(s, "([ECS])[^p]*$", 1)  # the first of the strong ones with no prose behind it
    strong = F.when(last == "E", "error").when(last == "C", "browser_check").when(last == "S", "script_notice")
    alone = s.rlike("^(?=[^p]*$)(?!.*o.*o)") | (flagged & s.rlike("w[^p]*$|s[^p]*$"))
    weak = F.when(alone & s.contains("w"), "error").when(alone & s.contains("s"), "browser_check")
    return F.coalesce(strong, F.when(s.contains("F"), "filler"), weak)


def template_residue(
    df: DataFrame,
    text: str = "story_content",
    host: str = "platform",
    key: str = "story_row_id",
    flag: str = "cloudflare_detected",
    min_share: float = 0.1,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """df's key with kind (`error`, `browser_check`, `script_notice`, `filler`, `slot` or null) and is_residue.

    Null and blank texts have no residue.  A row comes out once for every time it comes in, whatever its key.  A null
    host is a host of its own.  `flag` (left out if df has no such column; null is false) only tips weak evidence.
    `carry` adds columns; they may use the normalised text, `_t`.
    """
    carry = carry or {}
    flagged = F.coalesce(F.col(flag), F.lit(False)) if flag in df.columns else F.lit(False)
    x = df.withColumns({"_host": F.col(host), "_flag": flagged, "_t": normalised(F.col(text))})
    t = F.col("_t")
    some = may_show(t)
    split = F.filter(F.split(t, "\n"), lambda s: F.btrim(s) != "")
    x = x.select(
        key, "_host", "_flag", *[c.alias(n) for n, c in carry.items()],
        F.when(some, F.transform(split, lambda s: F.struct(F.xxhash64(s).alias("h"), line_class(s).alias("c")))).alias("_lines"),
        F.when(_any(t, SLOT_SIGNS) & (F.size(slot_lines(t)) > 0), "slot").alias("_slot"),
        F.when(F.concat(F.lit(" "), t).rlike(FILLER), "filler").alias("_run"),
        F.xxhash64(t).alias("_text"), F.when(t.isNotNull(), line_hashes(t)).alias("_hashes"),
    )
    x = saved(x)  # the texts are read and searched once; what follows needs only numbers and letters
    texts = x.filter("_hashes is not null").select("_host", "_text", "_hashes").dropDuplicates(["_host", "_text"])  # a copied text counts once
    often = boilerplate(texts, min_share)
    rest = x.drop("_text", "_hashes").join(often, F.col("_host").eqNullSafe(F.col("_of")), "left")
    shown = F.when(F.col("_lines").isNotNull(), judged(F.col("_lines"), F.col("_boiler"), F.col("_flag")))
    kind = F.coalesce(F.when(shown != "filler", shown), "_run", shown, "_slot")
    return rest.select(key, *carry, kind.alias("kind"), kind.isNotNull().alias("is_residue"))
