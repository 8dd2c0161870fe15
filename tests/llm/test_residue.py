import pytest

from rxweave.llm import residue as R

REAL = "The carer was started on Dolo 5 mg at the annex. Missed doses: 5 in the last month."
SLOTS = ["Dear {{ name }},", "{% drug_a %}", "<%= dose %>", "${next_review}", "#{dose}", "Take {dose} daily", "%(phone)s", "Dear %PATIENT_NAME%", "[[weight kg]]", "<<patient name>>", "[insert dose here]", "[your drug a]", "<enter phone>", "[PRESCRIBER]", "<DRUG_A>", "__DOSE__", "@@batch_no@@", "[drug_name]"]
NO_SLOTS = ["Dose range [5-10] mg, target <21 units, see column [mg/L].", "reaches [sic] or [SIC]", "must be called in [urgent].", '{"drug": "x", "dose": 1}', "Set {Aspirin, Warfarin} is the pair.", "Cost was $5 per strip and 5% of it.", "Field names such as patient_name and drug_a were agreed.", "<|endoftext|>", "Potassium <3.5 or >5.5", "a <br> b", "[1] and [a](b)", "x = y[i]", "if (a < b) {return c;}"]
FILLER = ["Lorem ipsum dolor sit amet, consectetur.", "Sample text goes here.", "Texto de relleno.", "Texte à venir.", "Blindtext Blindtext.", "TBD TBD TBD", "test test test 123 test", "xxxxx xxxx xxxxxxx", "asdf asdf asdf", "[description to follow]", "Type your note here...", "This paragraph is a placeholder and will be replaced.", "Hier steht später der Text."]
NO_FILLER = ["Lorem is the ward cat; a night nurse says hello.", "Nothing was found in the sample, and the text of the label was replaced.", "The text of the test was sent here for review.", "No no, that is fine.", "He put the sample here and left."]
PAGES = ["404 Not Found.", "Maintenance in progress. The drug index will return shortly.", "Please enable JavaScript to view this page.", "Access denied", "Forbidden (403) Back to start page", "Your session has expired. Please log in again to read the monograph.", "Seite nicht gefunden. Bitte prüfen Sie die Adresse.", "Accès refusé. Veuillez vous connecter.", "Checking your browser before you continue. This may take 5 seconds.", "noscript: scripts must be on to load the chart", "Clinic note T7 The request timed out while loading record d8.", "503 Service Temporarily Unavailable.\nTry again in 5 minutes.", "Oops! Something went wrong."]
NO_PAGES = ["Access was denied to a student at the annex because the badge had expired.", "Page not found in the old binder either, so it was looked up by hand.", "The terminal showed error 500 twice, so the refill was phoned through.", "The checker needs JavaScript, which the annex keeps off, so our neighbour rang us.", "On review, potassium had settled and heartburn was gone.", "Missed doses: 5 in the last month. 404 Not Found.", "Follow-up", "Ask about heartburn."]


def kind(text):
    slot, filler, message, content, left = R.read(text)
    return "slot" if slot else "filler" if filler else "message" if message and not content and left <= R.TITLE_WORDS else None


@pytest.mark.parametrize("kind_of, texts", [("slot", SLOTS), ("filler", FILLER), ("message", PAGES), (None, NO_SLOTS + NO_FILLER + NO_PAGES + [REAL])])
def test_kinds(kind_of, texts):
    assert {t: kind(t) for t in texts} == {t: kind_of for t in texts}


def test_filler_after_real_text():
    assert kind(REAL + "\nLorem ipsum dolor sit amet.") == "filler"


def run(spark, rows, **params):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, host string, text string, count int, lines string")
    return {r.doc_id: r.reason for r in R.residue(df, **params).collect()}


def test_documents(spark):
    rows = [(1, "h", "404 Not Found."), (2, "h", None), (3, "h", ""), (4, "h", " \n "), (5, "h", REAL), (6, None, "Dear {{name}}"), (7, "h", "TBD TBD TBD"), (8, "h", "x" * 200_000 + " [insert dose here]"), (1, "h", "404 Not Found.")]
    assert run(spark, rows) == {1: "message", 6: "slot", 7: "filler", 8: "slot"}
    assert run(spark, []) == {}


def test_recurrent_lines_are_subtracted(spark):
    chrome = "Interactions of the week, chosen by the editors of the drug index for all readers\nBrowse all leaflets\nLatest recalls and alerts\nOur newsletter"
    rows = [(k, "site", f"{chrome}\n{REAL} It was day {k} of {'abc'[k]}.") for k in range(3)] + [(10, "site", f"{chrome}\n404 Not Found."), (11, "elsewhere", f"{chrome}\n404 Not Found.")]
    assert run(spark, rows) == {10: "message"}
    assert run(spark, rows, recurrent=10**9) == {}


def test_slots_and_filler_in_boilerplate_are_no_case(spark):
    footer = "Printed for {{ user }} at Ward 7\nContent goes here"
    rows = [(k, None, f"{REAL} Note {'abcd'[k]}.\n{footer.replace('7', str(k))}") for k in range(4)] + [(9, None, f"{REAL} Dear {{{{ name }}}},\n{footer}"), (10, "h", f"{REAL}\n{footer}")]
    assert run(spark, rows) == {9: "slot", 10: "slot"}
    assert run(spark, rows, recurrent=10**9) == dict.fromkeys([0, 1, 2, 3, 9, 10], "slot")


def test_a_host_of_nothing_but_one_error_page(spark):
    rows = [(k, "dead", f"Access denied\nRequest id: {k}") for k in range(5)] + [(9, "dead", REAL)]
    assert run(spark, rows) == dict.fromkeys(range(5), "message")


def test_a_rare_line_is_no_boilerplate_and_repeated_texts_count_once(spark):
    rows = [(k, "h", f"{REAL} Number {k} of series {chr(97 + k % 26)}{chr(97 + k // 26)}.") for k in range(90)] + [(100 + k, "h", f"404 Not Found.\nNumber {k}") for k in range(4)] + [(200 + k, "h", "Dear {{name}},") for k in range(8)]
    assert run(spark, rows) == dict.fromkeys(range(100, 104), "message") | dict.fromkeys(range(200, 208), "slot")
