import random
import re
import time

from pyspark.sql import functions as F

from lociloom.llm import residue
from lociloom.llm.residue import with_residue, without_residue

FILL = "The frame is made of steel and has a width of 5 mm. "
CASES = [
    "ABSTRACT\n{{summary}}\n\nCLAIMS\n1. A pump, comprising a frame.", "Title: [[inventor]]\n\nAbstract:\n" + FILL, FILL + "${order_no} The pump runs.", FILL + "<%= total %>\n" + FILL, "CLAIMS\n1. <enter SUMMARY>\n2. @@x_y@@",
    "Beschreibung\n(Zusammenfassung noch zu ergänzen)\n", "摘要\n【请在此输入权利要求】\n", "说明书\n（发明名称待填写）\n", FILL + "*** TITLE MISSING - FILL IN ***\n", "ABSTRACT\n[INSERT title HERE]\n", "(71) %(embodiment)s\n\nAbstract", "<<date>>",
    "Abstract:\nLorem ipsum dolor sit amet, consectetur adipiscing elit.\n", "DESCRIPTION\nxxxxx xxxx xxxxxx xxx\n", FILL + "This is sample text used to fill the page.", "asdf asdf jkl jkl asdf", "Beschreibung\nDies ist ein Blindtext zum Füllen der Seite.",
    "ABSTRACT\nError 503: Service temporarily unavailable. Please try again later.", "404 Not Found\nThe requested publication could not be located on this server.", "Traceback (most recent call last):\n  File \"a.py\", line 3", FILL + "\nAccess denied. You do not have permission to view this document.",
    "Beschreibung\nFehler 404: Die angeforderte Seite wurde nicht gefunden.", "Description\nErreur 404 : la page demandée est introuvable.", "エラー404：お探しのページは見つかりませんでした。", "会话已过期，请重新登录。", "ZUGRIFF VERWEIGERT. IHRE SITZUNG IST ABGELAUFEN.",
    "Please enable JavaScript to view the full text.", "This site requires scripts. Turn on JavaScript in your browser settings and reload.", "In order to see the claims, enable script execution (required).", "Diese Seite benötigt Skripte.", "请启用JavaScript以查看全文。", "<noscript>Document view is not possible without JS.</noscript>",
]
NOT = [
    FILL, "", None, "   ", "The form generator looks for marks of the kind {{inventor}}, and the frame reports each mark.", "For example, the string 'Dear {{customer}},' becomes a salutation.", "Der Platzhalter __ID__ wird von Hülse durch den Messwert ersetzt.", "The template file holds fields written as ${order_no}; unfilled fields are found.",
    "\\left[ \\begin{matrix} {{a}_{11}} & {{a}_{12}} \\\\ 0 & 4", "##STR00031## [Math. 27] (Equation 4) 〔数3〕", "dQ/dt = -k_1 Q^{n} + {k_2", "A specimen line, here \"Lorem ipsum dolor sit amet consectetur\", is set in 12 sizes.", "The layout engine fills empty frames with dummy text (for instance lorem ipsum) to measure lines.",
    "If scripts are blocked, the frame shows the text \"Please enable JavaScript to view this.\" and the nozzle waits.", "The browser must allow scripts to run the claimed viewer; the frame is fixed.", "A message reading \"page not found\" is logged by the frame.", "An internal server error of the outlet port (code 500) triggers the watchdog.",
    "The service is temporarily unavailable while the frame is being exchanged.", "Access to the frame is denied by the nozzle until a token arrives.", "As filler, 12 wt% of chalk is added to the text ink; the filler content does not affect the frame.", "ページが存在しない場合、流路は軸受リングへコード404を返す。", "若页面不存在，所述出口向所述控制单元返回404代码。",
    "Use it so:\n```\n{{summary}}\n404 Not Found\n```\nThe frame prints it.",
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(CASES + NOT)], "doc_id long, text string, low string")
    found = {r.doc_id for r in with_residue(df).collect()}
    assert [CASES[i] for i in range(len(CASES)) if i not in found] == []
    assert [NOT[i - len(CASES)] for i in sorted(found) if i >= len(CASES)] == []
    assert {r.doc_id for r in without_residue(df).collect()} == set(range(len(CASES), len(CASES) + len(NOT)))


def test_very_long_and_empty_table(spark):
    df = spark.createDataFrame([(1, FILL * 20_000), (2, FILL * 20_000 + "\n{{summary}}\n")], "doc_id long, text string")
    assert [r.doc_id for r in with_residue(df).collect()] == [2]
    assert with_residue(df.limit(0)).count() == 0


def test_wrong_encodings(spark):
    latin = lambda t: t.encode().decode("latin-1")
    rows = [(1, latin("Beschreibung\nDer Dienst ist vorübergehend nicht erreichbar.")), (2, latin("Abrégé é") + "\u00e9x\u00c3"), (3, latin("摘要 会话已过期，请重新登录。")[:-1])]
    assert [r.doc_id for r in with_residue(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()] == [1]


def test_phrases_need_no_other_word(spark):
    alone = ["In order to see the claims, unblock JS and refresh.", "To continue, allow JS and refresh.", "404 Not Found", "403 Forbidden", "400 Bad Request", "Status 404.", "This is a placeholder text", "Filler text for the frame", "Please ena-\nble JS"]
    df = spark.createDataFrame(list(enumerate(alone)), "doc_id long, text string")
    assert sorted(r.doc_id for r in with_residue(df).collect()) == list(range(len(alone)))


# Wordings that were written after the grammars; none of UNSEEN was added to them, two of SPEAKING were mended
UNSEEN = [
    "JavaScript is currently switched off in your browser",
    "Please turn JavaScript on and reload.",
    "To use this viewer you must have scripting enabled.",
    "This application cannot run without JavaScript. Please check your settings.",
    "Your browser settings block scripts, which this page needs.",
    "HTTP 404",
    "Error code: 503",
    "504 Gateway Time-out",
    "The file you are looking for could not be found",
    "Our database is down for maintenance.",
    "Your request timed out.",
    "That page is no longer available.",
    "We could not load the document.",
    "An error occurred while loading this document.",
    "Diese Seite funktioniert nur mit aktiviertem JavaScript. Bitte schalten Sie es ein.",
    "Es ist ein interner Fehler aufgetreten.",
    "Der Server ist überlastet",
    "Veuillez activer JavaScript dans votre navigateur.",
    "La page n'a pas pu être chargée.",
    "Une erreur inconnue s'est produite",
    "Este documento necesita JavaScript para mostrarse.",
    "Ha ocurrido un error al cargar la página.",
    "La página no está disponible.",
    "您的浏览器未启用脚本，请启用后重试。",
    "网络错误",
    "サーバーエラーが発生しました",
    "Description to follow",
    "[Enter the title of the invention]",
    "TODO: write abstract",
    "Example content for testing only",
    "Texto provisional",
    "Text folgt.",
]
SPEAKING = [
    "The browser executes JavaScript code that requires a lock on the frame buffer.",
    "The controller blocks scripts whose signature is not found in the memory.",
    "The page is found in the cache and the frame is released.",
    "When the server is unavailable, the nozzle waits for the next cycle.",
    "The request timed out after the third attempt, and the frame counter was reset.",
    "The document server is connected to the frame over a bus.",
    "The database is down-sampled by the filter.",
    "An error code is written to the register of the frame.",
    "Ein Fehler des Sensors wird durch die Steuereinheit erkannt.",
    "Der Server ist mit der Steuereinheit verbunden.",
    "Une erreur de mesure est corrigée par le capteur.",
    "El servidor está conectado con la unidad de control.",
    "La page mémoire est effacée avant l'écriture.",
    "系统错误率低于百分之一。",
    "スクリプトは制御部により実行される。",
    "Insert pins are placed here and there along the frame.",
    "Text is entered by the user in the input field and the description is stored.",
    "The connection is not available for the first port, which is closed by the lid.",
    "The content of chalk is 12 wt%.",
    "A sample sentence is read aloud by the speaker to train the model.",
    "The script requires the frame to be turned by 90 degrees.",
    "Scripts must be stored in the memory of the controller before the frame starts.",
    "The website stores the identifiers, and the viewer shows the frame.",
    "The file is not found in the first folder, so that the second folder is read.",
]


def test_unseen_wordings(spark):
    df = spark.createDataFrame([(i, f"ABSTRACT\n{t}\n\nCLAIMS\n1. A pump, comprising a frame.") for i, t in enumerate(UNSEEN + SPEAKING)], "doc_id long, text string")
    found = {r.doc_id for r in with_residue(df).collect()}
    assert len([i for i in found if i < len(UNSEEN)]) >= 30 and not [SPEAKING[i - len(UNSEEN)] for i in found if i >= len(UNSEEN)]


def test_names_and_quotes_of_any_length(spark):
    long_name, long_quote = "a" * 3_000, FILL * 60
    rows = ["{{" + long_name + "}}", "[[" + "inventor name " * 30 + "]]", "[insert " + "the title " * 40 + "]", f'A note says "{long_quote} {{{{title}}}}" on its cover.']
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(r.doc_id for r in with_residue(df).collect()) == [0, 1, 2]


def test_a_line_that_explains_many_placeholders(spark):
    told = "Marks are written as {{a1}}, as {{b1}} or as {{c1}} in the file, and {{d1}} ends it. {{e1}} Each is read."
    df = spark.createDataFrame([(0, told), (1, "Marks end it. {{e1}} Each is read."), (2, "{{a1}} {{b1}} {{c1}}\n{{d1}}")], "doc_id long, text string")
    assert sorted(r.doc_id for r in with_residue(df).collect()) == [1, 2]


def test_sentences_without_any_other_content(spark):
    alone = ["Bitte versuchen Sie es.", "Este es un texto de ejemplo.", "Texto de muestra", "Vuelva a intentarlo", "Veuillez réessayer.", "This is example text.", "bla bla bla bla", "Hier steht später", "jkl jkl jkl jkl"]
    df = spark.createDataFrame(list(enumerate(alone)), "doc_id long, text string")
    assert sorted(r.doc_id for r in with_residue(df).collect()) == list(range(len(alone)))


def _sample(nodes, rnd):
    """A text that a parsed pattern matches, but for what it looks for around."""
    out = ""
    for kind, value in nodes:
        kind = str(kind)
        if kind == "LITERAL":
            out += chr(value)
        elif kind == "IN":
            k, v = rnd.choice(value)
            out += chr(v) if str(k) == "LITERAL" else chr(rnd.randint(*v)) if str(k) == "RANGE" else {"CATEGORY_DIGIT": "7", "CATEGORY_WORD": "w"}.get(str(v), " ")
        elif kind == "BRANCH":
            out += _sample(rnd.choice(value[1]), rnd)
        elif kind == "SUBPATTERN":
            out += _sample(value[3], rnd)
        elif kind.endswith("REPEAT"):
            out += "".join(_sample(value[2], rnd) for _ in range(rnd.randint(value[0], min(int(value[1]), value[0] + 2))))
    return out


def test_every_phrase_passes_the_screen(spark):
    rnd, rows = random.Random(5), []
    accents = str.maketrans("aeiouc", "\u00e0\u00c9\u00ee\u00d6\u00fa\u00c7")
    for p in [*(p for ps in residue.STARTS.values() for p in ps), residue.ANYWHERE, "please enable javascript", "this site needs js, sorry"]:
        for _ in range(60):
            said = re.sub(" ", lambda m: rnd.choice([" ", "  ", "\n"]), _sample(re._parser.parse(p), rnd))
            said = rnd.choice([said, said.upper(), said.title(), said.translate(accents), said.replace("'", "\u2019")])
            rows.append((len(rows), rnd.choice(["", "Abstract\n", "A pump\u2026 ", "Ende. ", "\u7d42\u3002", "Abstract - ", "1) \u2022 "]) + said + rnd.choice(["", ".", "\n", " \u300c"])))
    df = spark.createDataFrame(rows, "i long, text string")
    x, (_, may) = residue._content(residue._folded(F.col("text"))), residue._may_have(F.col("text"))
    got = df.select("text", (x.rlike(residue._phrases()) | residue._notice(x)).alias("said"), may.alias("may")).collect()
    assert sum(r.said for r in got) > len(rows) / 2 and [r.text for r in got if r.said and not r.may] == []


def test_plain_text_costs_less_than_the_phrases(spark):
    df = spark.createDataFrame([(i, FILL * 1_000 + "Es l\u00e4uft.") for i in range(160)], "doc_id long, text string").repartition(4).cache()
    full = residue._content(residue._folded(F.col("text"))).rlike(residue._phrases())
    took = []
    for find in (lambda: with_residue(df).count(), lambda: df.filter(full).count()):
        find()
        began = time.time()
        assert find() == 0
        took.append(time.time() - began)
    assert took[0] < took[1]
