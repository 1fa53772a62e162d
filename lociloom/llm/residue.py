"""Texts with unfilled placeholders, filler text, error messages or script notices in place of content.

Placeholders are found by a grammar per delimiter. A find counts only where content belongs: it starts where a line, a sentence or a formula
ended, and a line's end or a new sentence follows. Inside a sentence it is spoken of, as in a patent on templates, and a line in which many are
spoken of for each that stands explains them. Code blocks and quoted strings are blanked first, so that tutorials and cited messages don't count. Filler, messages and notices are phrases per language that
stand as a sentence of their own.

Every pattern is tried on every text, first in a form for the text as it is that needs no backtracking (`unfolded`, derived from the same
patterns). Where one of those matches, or the text holds what isn't folded sign by sign, built-in expressions fold the whole text and judge it.
"""

from __future__ import annotations

import re
from functools import cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociloom.llm.unfolded import unfolded

# a name of any length on one line
_ID = r"[\p{L}\p{N}_][\p{L}\p{N} _.\-]*+"

#: Grammars by delimiter. Everything between delimiters may be of any length on one line.
PLACEHOLDERS = {
    "braces": [rf"\{{\{{\{{? ?{_ID}\}}?\}}\}}", rf"\$\{{ ?{_ID}\}}", rf"#\{{ ?{_ID}\}}", r"\{[\p{L}_][\p{L}\p{N} _.\-]{2,}+\}"],
    "tags": [rf"<%=? ?{_ID}%>", rf"<\?=? ?\$?{_ID}\?>", rf"\{{% ?\p{{L}}++ {_ID}%\}}", rf"&lt;{_ID}&gt;", rf"<<{_ID}>>", rf"«{_ID}»"],
    "marks": [rf"%\({_ID}\)[sd]", rf"%%{_ID}%%", r"%[A-Z_]{2,}+%", rf"@@{_ID}@@", r"__[\p{L}\p{N}](?:[\p{L}\p{N} .\-]|_(?!_))*+__", rf"\[\[{_ID}\]\]", r"\$\p{L}[\p{L}_.\-]{3,}+\$", rf"~~{_ID}~~", rf"\|\*{_ID}\*\|"],
    "orders": [
        r"\*\*\* ?[^*\n]{2,}?(?:MISSING|FILL IN|TODO|TBD)[^*\n]*+\*\*\*",
        r"\[(?i:insert|insertar|insérer|einfügen|your|please|todo|tbd|enter|add|fill|hier|introduzca|saisir|inserte)\b[^\]\n]++\]",
        rf"\[{_ID}: ?[xX]{{3,}}\]",
        r"\[[^\]\n]++(?<=. (?i:here|einfügen|eingeben|ici|aquí))\]",
        r"< ?(?i:enter|insert|click to add|introduzca|inserte|saisir|saisissez|type|your) [^<>\n]++>",
        r"<[^<>\n]++(?<=. (?i:goes here|here|eingeben|einfügen|ici|aquí) ?)>",
        r"\([^()\n]++(?<=. (?i:to be (?:completed|supplied|added|filled in|inserted|provided)[^()\n]{0,30}|noch zu ergänzen|noch einzufügen|à compléter|à insérer|por completar|a completar|pendiente))\)",
        r"[（(][^（）()\n]++(?<=.(?:待填写|待补充|待定|後で記入|未記入|記入予定|要記入))[）)]",
        r"【(?:请在此|此处|ここに|こちらに)[^】\n]++】",
    ],
}

#: What may stand before and after a placeholder in place of content. It is looked for at a delimiter's first character only.
_FIRST = r"(?=[{$#<%@_\[&«~|*(（【])"
_BEFORE = (
    r"(?<=(?:^|[\n.!?。！？…)\]#〕>}】][\"”']?)[ \t]{0,3}"
    r"|(?:^|\n)(?:[\p{L} .]{1,24}[:\-]|[\-*•]|\[\d{1,6}\]|\(\d{1,3}\)|\d{1,3}[.)])[ \t]{0,3})"
)
_AFTER = r"(?=[ \t]*+(?:$|\n|</|[\p{Lu}\p{Lo}\p{N}\[(<{#~|*@%$«【_&\\（]))"
_ANY = "(?:" + "|".join(p for ps in PLACEHOLDERS.values() for p in ps) + ")"
SPOT = _FIRST + _BEFORE + f"(?:{_ANY}[ \\t]*+)++" + _AFTER
#: Density: a line that speaks of at least so many placeholders for each that stands in it explains them, as a tutorial does.
SPOKEN_OF = 2

# fixed values: words of the usual dummy Latin
_LATIN = (
    "lorem|ipsum|dolor|dolore|sit|amet|consectetur|adipiscing|elit|sed|eiusmod|tempor|incididunt|labore|magna|aliqua|enim|minim|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|commodo|consequat|duis|aute|irure"
    "|reprehenderit|voluptate|velit|esse|cillum|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|proident|sunt|culpa|officia|deserunt|mollit|anim|laborum|ut|et|ad|ex|ea|in|eu|non|qui|id|est|do"
    "|porta|morbi|urna|felis|tellus|gravida|semper|dictum|ultrices|luctus|congue|vitae|mauris|pretium|pharetra|nibh|sapien|quam|lacus|varius|ornare|nunc|vestibulum|vivamus|viverra|vel|ac|at|nec|orci|odio|eget|turpis|massa|donec|integer|purus|libero|justo"
)
_SCRIPT = r"(?:active |client-side |the )?(?:javascript|js|scripts?|scripting|script execution)\b"

_SWITCH = "(?:enable|activate|allow|turn on|switch on|permit|unblock|accept|re-enable)"
_NOT = r"(?:cannot|can't|can not|could not|couldn't|did not|didn't|failed to|(?:is|are|was|were|'re) (?:currently )?unable to)"
_SHOW = r"(?:display|show|open|load|retrieve|deliver|fetch|find|locate|render|return|access|process) (?:the|this|that|your|any|sheet|page|document)\b"

# Words of the notice grammar: what is to run, what it takes, and who is spoken to. A sentence with all three is a notice.
_NOUN = r"(?=[jsス-脚])(?:(?<!\p{L})(?:java ?script|js|scripts?|scripting|skripte)(?!\p{L})|javascript|スクリフ?゚?プ?ト|脚本)"
_TAKES = r"(?:enabl|activ|allow|turn|switch|permit|unblock|block|disabl|requir|need|necess|must|without|aktivier|einschalt|eingeschaltet|erlaub|benotig|erforder|brauch|deaktiv|habilit|autoris|requi|necesit|desactiv|启用|开启|打开|禁用|需要|不支持|有効|必要|許可|無効)"
_YOU = (
    r"(?:[ \t]*+java ?script(?!\p{L})|[ \t]*+(?:in order )?(?:to|for full) |[^.!?\n>]*?(?:(?<!\p{L})(?:you|your|please|we're|sorry|this (?:web ?)?(?:site|page|app|application|document|viewer)"
    r"|sie|ihr|ihrem|ihren|bitte|diese[rs]? (?:seite|anwendung|website|dokument)|vous|votre|veuillez|cette (?:page|application)|ce (?:site|document)|su navegador|por favor|esta (?:pagina|aplicacion)|este (?:sitio|documento)|necesita)(?!\p{L})"
    r"|[请您]|此页|本页|本网站|このヘ?゚?ペ?ーシ?゛?ジ?|このサイト|お使い|してくた?゛?だ?さい))"
)
NOTICE = rf"[.!?\n>](?=[^.!?\n>]*?(?:{_NOUN}))(?=[^.!?\n>]*?{_TAKES})(?={_YOU})"
# Words of the message grammar: things of a web page, and how they fail.
_THING = r"(?:(?:the|this|our|your|that) )?(?:requested |web |remote |document )*(?:page|site|website|document|file|url|server|servers|service|system|connection|request|session|app|application|viewer|publication|database|content)(?: you (?:requested|are looking for|asked for))?"
_FAILS = (
    r"(?:(?:is|was|are|were|isn't|aren't|has|have|seems|appears|to be|been|currently|temporarily|momentarily|no longer|not) ){1,4}(?:unavailable|available|found|working|responding|reachable|loading|accessible|overloaded|expired|failed|timed out|offline|down|down for maintenance|under maintenance|broken)"
    r"|timed out|failed|has failed|did not respond|does not respond|(?:could not|cannot|can't|couldn't) be (?:loaded|found|displayed|reached|opened|retrieved|processed)"
)
_END = r"(?: (?:right now|at the moment|at this time|at present|for now|on our end|due to \w+(?: \w+)?))?[ \t]*+(?=[.!;<\n]|$)"

#: Phrases that begin a sentence; accents are folded and letters lower before they are compared.
STARTS = {
    "notice": [
        rf"(?:please |you (?:need|have|must) (?:to )?|kindly )?(?:please )?{_SWITCH} {_SCRIPT}",
        r"javascript (?:is|has been|seems to be|appears to be|must be|needs to be) (?:disabled|required|turned off|switched off|blocked|enabled|necessary|not enabled|needed)",
        r"(?:notice ?[\-:–] ?)?this (?:site|page|app|application|document|section|content|viewer) (?:requires|needs|works only with|relies on|does not work without) (?:\w+ ){0,3}(?:javascript|script)",
        r"your browser (?:does not|doesn't|cannot) (?:support|run|execute|display)",
        r"scripts?(?: and cookies)? must be (?:allowed|enabled)",
        r"document view is not possible|loading viewer|if nothing happens, ",
        r"bitte (?:aktivieren|erlauben) sie (?:javascript|skripte)|diese (?:seite|anwendung|website) (?:benotigt|erfordert|braucht) (?:javascript|skripte)|ihr browser (?:hat|unterstutzt)|javascript ist (?:deaktiviert|erforderlich)",
        r"veuillez (?:activer|autoriser) (?:javascript|les scripts)|(?:ce site|cette page|cette application) (?:necessite|requiert) |javascript est desactive",
        r"(?:por favor, )?(?:active|habilite|activa) (?:javascript|los scripts)|(?:este sitio|esta pagina|esta aplicacion) (?:necesita|requiere) (?:scripts|javascript)",
        r"请(?:启用|开启|打开) ?(?:javascript|脚本)|您的浏览器",
    ],
    "message": [
        rf"(?:sorry, |oops, )?{_THING} (?:{_FAILS}){_END}",
        r"(?:http )?(?:status|error)(?: code)? ?:? ?[45]\d\d\b|[45]\d\d(?: [a-z]+){0,2} (?:error|timeout|denied|unavailable|forbidden|refused)\b|(?:sorry, )?something went wrong",
        r"(?:es ist )?ein (?:\w+ )?fehler (?:ist )?aufgetreten|(?:die|diese) (?:seite|datei|anfrage) (?:konnte|kann) (?:leider )?nicht|(?:der|unser) (?:server|dienst) (?:antwortet nicht|ist (?:uberlastet|in wartung))",
        r"une erreur (?:\w+ )?(?:est survenue|s'est produite)|(?:le|notre) (?:serveur|service|site) (?:est (?:en (?:cours de )?maintenance|indisponible|surcharge)|ne repond pas)|(?:la|cette) page (?:n'a pas pu|ne peut pas) etre",
        r"(?:se ha producido|ha ocurrido) un error|(?:el|nuestro) (?:servidor|servicio|sitio) (?:no (?:responde|esta disponible)|esta en mantenimiento)|(?:la|esta) pagina no (?:se puede|se pudo|esta disponible)",
        r"(?:系统|网络|未知|内部)错误(?=[，.;!\s]|$)|请稍[后候]再试|(?:システム|サーハ?゛?バ?ー|予期しない|不明な|内部)エラー(?:か?゛?が?発生|て?゛?で?す)|しは?゛?ば?らくしてから",
        r"(?:http )?error \d{3}\b|status \d{3}\.|[45]\d\d (?:bad gateway|not found|internal server error|forbidden|service unavailable|gateway time-?out|unauthorized|bad request)",
        r"internal server error *(?=\n|$|[.<])",
        r"(?:the )?service (?:is )?(?:temporarily |currently )?(?:unavailable|not available) *(?=[.!<\n]|$)",
        rf"(?:sorry, )?(?:we|the (?:server|gateway|service|system|site|host|viewer|application)) ?{_NOT} {_SHOW}",
        rf"(?:sorry, )?(?:it (?:was|is) not possible to|unable to|failed to) {_SHOW}",
        r"an? (?:unexpected |unknown |internal |server )?error (?:has )?occurred|(?:please )?contact the help ?desk|request failed *(?=[.!<\n]|$)|<title>\d{3}</title>",
        r"the (?:requested (?:page|document|publication|file|url)|(?:page|document) you (?:asked for|requested|are looking for)) (?:could not|was not|cannot|can't|no longer|does not|is not|has been)",
        r"access denied *(?=[.!<\n]|$)|you do not have permission|your session has (?:expired|timed out|ended)|too many requests *(?=[.!<\n]|$)",
        r"(?:document )?server (?:is )?under maintenance|oops|something went wrong|the upstream (?:host|server)|some content cannot be displayed|the full text service did not",
        r"traceback \(most recent call last\)|(?:at )?(?:java|javax|org|com)\.[\w.]+(?:exception|error)\b|warning: \w+\(\)|ocr_failed|keyerror: ",
        r"(?:please )?try again (?:later|in a few)|(?:please )?reload the page|return to the (?:start|home) ?page",
        r"fehler \d{3} ?:|die (?:angeforderte|gesuchte|gewunschte) seite|die seite / |zugriff verweigert|ihre sitzung ist|der (?:dienst|server) ist (?:vorubergehend|derzeit|zurzeit) nicht (?:erreichbar|verfugbar)|bitte versuchen sie es",
        r"erreur \d{3} ?:|la page (?:demandee|recherchee) (?:est|n'existe)|acces refuse|votre session a expire|service (?:momentanement|temporairement|actuellement) indisponible|veuillez reessayer",
        r"no se ha encontrado la pagina|la pagina (?:solicitada|buscada) no |acceso denegado|su sesion ha|servicio no disponible|vuelva a intentarlo|intentelo ",
        r"エラー ?\d{3}|お探しのペ|セッションの有効期限|サ[ーｰ]ハ?゛?バ?ーか?゛?が?混み合|アクセスが拒否|错误 ?\d{3}|您访问的页面|会话已|服务器(?:繁忙|错误|维护)|拒绝访问|访问被拒绝",
    ],
    "filler": [
        rf"(?:{_LATIN})(?:,? (?:{_LATIN})){{3,}}|lorem ipsum dolor",
        r"(?:please )?(?:insert|add|type|enter|put|paste|write) (?:your |the |an? )?(?:own )?(?:abstract|title|text|description|claims?|summary|name|content)(?: text)? here",
        r"(?:sample|dummy|filler|example|mock) (?:paragraph|sentence|content|copy) (?:for|to|only|goes|used)\b|text to (?:be (?:replaced|supplied|added|inserted)|follow|come)\b|(?:content|abstract|description|text|title) (?:to follow|coming soon|goes here|to come)\b",
        r"platzhaltertext\b|text (?:folgt|wird (?:spater|noch) (?:ersetzt|erganzt|eingefugt))|texte (?:provisoire|bidon|a (?:remplacer|completer|venir))|texto (?:provisional|ficticio|por (?:reemplazar|completar)|pendiente)",
        r"(?:asdf|qwerty|jkl|blah|bla)(?:[ ,]+(?:asdf|qwerty|jkl|blah|bla)){2,}|x{4,}(?: x{3,})+|(?:text|test)(?: (?:text|test)){2,}",
        r"this is (?:a )?(?:sample|dummy|filler|placeholder|example) text|(?:dummy|sample|filler) text for|placeholder (?:paragraph|text|sentence)\b|this paragraph only shows|body copy goes|sample sentence number|nothing in this section is",
        r"dies ist ein (?:blindtext|mustertext|fulltext|beispieltext)|nur ein (?:mustertext|blindtext|beispieltext)|hier steht (?:spater|bald)\b",
        r"(?:ceci est un )?(?:faux texte|texte (?:d'exemple|de remplissage|factice))|(?:este es un )?texto de (?:relleno|ejemplo|muestra)",
        r"此处为示例|这里是填充|此处为占位|ここに(?:サンプル|本文|文章|テキスト)",
    ],
}
#: Phrases that count wherever they stand, outside quotes: those with a script in them, and others.
ANYWHERE_SCRIPT = rf"(?=[,pnhb])(?:(?:, |\bplease |\bneed to |\bhave to ){_SWITCH} {_SCRIPT}|because (?:script execution|javascript|scripting) is (?:blocked|disabled|off)|page works only with script|not possible without js\b)"
ANYWHERE = r"(?:javascript ?を有効に(?:して|する)|スクリ[プフ]゚?トの実行か?゛?が?必要|[タダ]゙?ミーテキスト[でて]|浏览器已?(?:禁用|不支持)|示例文字|填充文本|错误\d{3}:|页面(?:不存在|未找到)。)"
#: Lines of a web page's navigation.
NAVIGATION = r"(?:\p{L}++(?: \| \p{L}++){2,3}|< ?\p{L}++ \| \p{L}++ ?>|back to results|\(c\) document service)[ \t]*+(?=\n|$)"
_ACCENTS = ("áàâäãéèêëíìîïóòôöúùûüçñ’", "aaaaaeeeeiiiioooouuuucn'")
_WIDE = ("\u00a0\u3000\u2009\u202f。！？；：…】〕", "    .!?;:.]]")
_CODE = r"(?s)```.*?```|<pre\b.*?</pre>|<code\b.*?</code>"
_QUOTED = r"\"[^\"\n]++\"|“[^”\n]++”|「[^」\n]++」|(?<!\p{L})'[^'\n]++'(?!\p{L})"


def _spaced(pattern: str) -> str:
    """A space in a phrase, outside brackets, also stands for a line break or several spaces."""
    spaces = re.sub(r"\[[^\]]*\]| ", lambda m: m[0] if m[0] != " " else r"\s+", pattern)
    return spaces.replace(r"\s+?", r"\s*").replace(r"\s+*", r"\s*")


def _phrases() -> str:
    """Phrases behind the end of a sentence, a mark or a label, and lines of navigation, of a folded text.

    One class of characters tells where a branch can begin; it has few parts, for a class of many single signs is slow.
    """
    starts = _spaced("|".join(p for ps in STARTS.values() for p in ps))
    sentence = rf"[\n.!?;:|>)\]#}}]\s*+(?:[\-*•]\s*+)?(?:{starts})"
    line = rf"\n[ \t]*+(?:(?:[a-z .]{{1,24}}\- ?|ref\. )(?:{starts})|{_spaced(NAVIGATION)})"
    return rf"(?=[\n.!?;:|>)\]#}}jス-页])(?:{sentence}|{line}|{_spaced(ANYWHERE)})"


def _notice(folded: Column) -> Column:
    """The notice grammar and the phrases with a script, where a script is named at all, as both demand.

    The words are looked for first without those that begin with "descript", which every text has and no noun of the grammar does.
    """
    bare = F.replace(folded, F.lit("descript"), F.lit(""))
    named = reduce(or_, [bare.contains(w) for w in ("script", "js", "skript", "スクリ", "脚本")])
    return F.when(named, F.when(folded.rlike(_NOUN), folded.rlike(_spaced(f"{NOTICE}|{ANYWHERE_SCRIPT}")))).otherwise(False)


def _fold(c: str) -> str:
    """What _folded() makes of a single character."""
    return c.lower().translate(str.maketrans(_ACCENTS[0] + _WIDE[0], _ACCENTS[1] + _WIDE[1])).replace("\u0307", "")


#: What isn't folded sign by sign, or is not looked for in a text that isn't folded: what is left out, white space, code blocks and lines of
#: navigation. Quotes don't count, as no phrase has a quotation mark or reaches into one.
_NOT_BY_SIGN = "[\u00a0\u00ad\u0130\u0300-\u036f\u2009\u200b-\u200f\u202f\u2060\u3000\ufeff|]|-\n|```|(?i:<pre|<code)"


@cache
def _screens() -> dict[str, list[str]]:
    """Patterns one of which matches a text that isn't folded wherever it has a placeholder, a phrase or a script by name, or can't be told.

    They are many, as each has its own table of states: one for all would outgrow it and be tried slowly.
    """
    before = unfolded([r"[\n.!?;:|>)\]#}\-]"], _fold)
    said = [("navigation", [r"back to results|\(c\) document service"]), *((k, ps[i : i + 8]) for k, ps in STARTS.items() for i in range(0, len(ps), 8))]
    out = {
        "placeholder": [unfolded([p]) for ps in PLACEHOLDERS.values() for p in ps],
        "odd": [_NOT_BY_SIGN],
        "anywhere": [unfolded([ANYWHERE], _fold)],
        "script": [rf"(?:^|[^\p{{L}}]){unfolded(['js|scripts?|scripting|skripte'], _fold)}(?:$|[^\p{{L}}])|{unfolded(['java ?script|スクリ|脚本'], _fold)}"],
    }
    for kind, patterns in said:
        out.setdefault(kind, []).append(rf"(?:^|{before})[\s\x0b]*(?:[\-*•][\s\x0b]*)?{unfolded(patterns, _fold)}")
    return out


def _may_have(text: Column) -> tuple[Column, Column]:
    """Whether a text may have a placeholder, and whether it may say a phrase or a notice; true at least where it does. Null texts give null."""
    screens = _screens()
    spots, said = screens["placeholder"], [p for k, ps in screens.items() if k != "placeholder" for p in ps]

    def screen(texts):
        import pyarrow as pa
        import pyarrow.compute as pc

        out = pa.nulls(len(texts), pa.int32()).fill_null(0)
        for bit, patterns in ((1, spots), (2, said)):
            for p in patterns:
                out = pc.bit_wise_or(out, pc.multiply(pc.match_substring_regex(texts, p).cast(pa.int32()), bit))
        return out

    found = F.arrow_udf(screen, "int")(text)
    return tuple((found.bitwiseAND(bit) > 0) | ~F.is_valid_utf8(text) for bit in (1, 2))


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _folded(text: Column) -> Column:
    """A line break and the text in lower case, without accents, wide punctuation, invisible characters, soft hyphens and hyphenated line breaks."""

    def fold(t: Column) -> Column:
        plain = F.translate(t, _ACCENTS[0] + _WIDE[0], _ACCENTS[1] + _WIDE[1])
        return F.regexp_replace(plain, "[\u00ad\u200b-\u200f\u2060\ufeff\u0300-\u036f]|(?<=\\p{L})-\n(?=\\p{Ll})", "")

    changes = lambda t: t.contains("-\n") | t.rlike(f"[\u00a0\u00ad{_ACCENTS[0][:-1]}\u0300-\u036f\u2009-\uffff]")
    return F.transform(F.array(F.lower(F.concat(F.lit("\n"), text))), lambda t: F.when(changes(t), fold(t)).otherwise(t))[0]


def _content(text: Column) -> Column:
    """Text with code blocks and quoted strings blanked. A text without an opening mark is passed on as it is."""

    def blank(value: Column, marks: list[str], pattern: str, by: str) -> Column:
        has = lambda t: reduce(or_, [t.contains(m) for m in marks])
        return F.transform(F.array(value), lambda t: F.when(has(t), F.regexp_replace(t, pattern, by)).otherwise(t))[0]

    code = blank(F.replace(text, F.lit("&quot;"), F.lit('"')), ["```", "<pre", "<code"], _CODE, " code ")
    return blank(code, ['"', "“", "「", "'"], _QUOTED, '"quoted"')


def _repaired(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read rightly, with marks for what isn't UTF-8; other texts as they are."""
    wrong = ~_ascii(text) & text.rlike("[\u00c2-\u00f4][\u0080-\u00bf]") & ~text.rlike("[^\\x00-\u00ff]")
    return F.when(wrong, F.make_valid_utf8(F.encode(F.when(wrong, text), "ISO-8859-1").cast("string"))).otherwise(text)


def _stands(line: Column) -> Column:
    """True for a line with a placeholder in place of content that doesn't speak of many more."""
    return line.rlike(SPOT) & (F.regexp_count(line, F.lit(_FIRST + _ANY)) <= (1 + SPOKEN_OF) * F.regexp_count(line, F.lit(SPOT.replace(")++", ")"))))


def has_residue(text: Column) -> Column:
    """True where content is missing and a placeholder, filler, message or notice stands instead; null and empty texts give false.

    exists() over one element binds a value that is used many times, so that it is computed once.
    """

    def spot(t: Column) -> Column:
        return t.rlike(SPOT) & F.exists(F.split(_content(t), "\n"), _stands)

    def said(t: Column) -> Column:
        return F.exists(F.array(_content(_folded(t))), lambda x: x.rlike(_phrases()) | _notice(x))

    found = [F.coalesce(F.when(may, F.exists(F.array(text), judge)), F.lit(False)) for may, judge in zip(_may_have(text), (spot, said))]
    return found[0] | found[1]


def with_residue(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs whose text has residue, all columns kept. Repeated rows stay; other columns may have any name."""
    return docs.filter(has_residue(_repaired(F.col(f"`{text}`"))))


def without_residue(docs: DataFrame, text: str = "text") -> DataFrame:
    """The other rows, those without a text included."""
    return docs.filter(~has_residue(_repaired(F.col(f"`{text}`"))))
