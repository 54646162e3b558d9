import pytest

from knotwork.llm.pairs import with_defects

PROMPT = "Explain why the lock manager drops the retry counter when the queue drains."
CASES = [
    (PROMPT, None, ["empty"]),
    (PROMPT, " ​\n", ["empty"]),
    (PROMPT, "<answer></answer>", ["empty"]),
    (PROMPT, "```\n```", ["empty"]),
    (PROMPT, "(empty)", ["empty"]),
    (PROMPT, "N/A", ["empty"]),
    (PROMPT, "7", []),
    (PROMPT, "src/core/x.ts", []),
    (PROMPT, "Yes.", []),
    (PROMPT, "The counter is dropped since the", ["truncated"]),
    (PROMPT, "The counter is dropped.\n\n```py\ndef f(", ["truncated"]),
    (PROMPT, "The counter is dropped.\n\n```py\ndef f():\n    pass\n```", []),
    (PROMPT, "The counter is dropped.\n\n- the lock\n- the queue", []),
    (PROMPT, PROMPT.upper() + "!", ["copy"]),
    (PROMPT, "Question: " + PROMPT, ["copy"]),
    (PROMPT, PROMPT + "\n" + PROMPT, ["copy"]),
    (PROMPT, PROMPT + "\n\nBecause the lock is lost and the counter is in it.", []),
    (PROMPT, "I'm sorry, but I can't help with that request.", ["refusal"]),
    (PROMPT, "Tut mir leid, dabei kann ich nicht helfen.", ["refusal"]),
    (PROMPT, "Je ne peux pas répondre à cette demande.", ["refusal"]),
    (PROMPT, "Lo siento, no puedo ayudar con esa petición.", ["refusal"]),
    (PROMPT, "Sorry for the long diff: the lock needed two changes and a test for it.", []),
    (PROMPT, "I cannot reproduce the failure on a clean checkout, so I pinned the clock in the test.", []),
    (PROMPT, "Der Zähler wird verworfen, weil die Sperre verloren geht und der Index nicht neu gebaut ist.", ["wrong_language"]),
    (PROMPT + " Answer in German.", "Der Zähler wird verworfen, weil die Sperre verloren geht und der Index nicht neu gebaut ist.", []),
    (PROMPT + " Answer in German.", "The counter is dropped because the lock is lost when the queue drains.", []),
    (PROMPT, "Счётчик сбрасывается, потому что блокировка потеряна.", ["wrong_language"]),
    (PROMPT, "The counter is dropped because the lock is lost. “Der Zähler ist weg, weil die Sperre nicht hält und das war es.”", []),
    (PROMPT, "The counter is dropped.\n\n- the lock is lost.\n- the queue drains.\n- the wor", ["truncated"]),
    (PROMPT, "The counter is dropped.\n\n- the lock\n- the queue of the", ["truncated"]),
    (PROMPT, "The counter is dropped (see the queue and its lock.", ["truncated"]),
    (PROMPT, "The counter is dropped: “the lock is lost", ["truncated"]),
    (PROMPT, "1) The counter is dropped. 2) The lock is lost :( for good.", []),
    (PROMPT, "The counter is dropped (see the lock [and queue]).", []),
    (PROMPT, "Here once more is the whole task that you have given to me in your message above:\n" + PROMPT, ["copy"]),
    (PROMPT, "The lock is lost and the queue drains, then the counter goes. " + PROMPT, []),
    (PROMPT, "```\nN/A", ["empty", "truncated"]),
    ("Explain why it fails.", "Il ne faut jamais vider la file quand le verrou est perdu parce que les lignes ne sont pas valides.", ["wrong_language"]),
    ("Объясни, почему lock сбрасывает счётчик.", "Потому что блокировка теряется, и счётчик начинается заново.", []),
    ("Объясни, почему lock сбрасывает счётчик.", "The counter starts again because the lock is lost.", ["wrong_language"]),
    ("Translate this into Russian: the lock is lost and the counter is dropped.", "Блокировка потеряна, и счётчик сброшен.", []),
    ("ロックが失われる理由を lock manager について説明してください。", "キューが空になると、ロックは失われます。", []),
    (None, "A whole answer to nothing, and that is that.", []),
    ("", "", ["empty"]),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, p, o, "clash", 1) for i, (p, o, _) in enumerate(CASES)], "k int, prompt string, output string, p string, empty int")
    got = {r.k: r.defects for r in with_defects(df).collect()}
    first = lambda d: d[:1] if "refusal" in d else d  # noqa: E731 - a refusal may be in another language too
    wrong = {i: (CASES[i], got[i]) for i in got if first(got[i]) != CASES[i][2]}
    assert not wrong


def test_refusals_of_any_length(spark):
    why = "This request is against the policy that I follow, because it may do harm to other people. " * 8
    restated = (PROMPT + " ") * 4
    solved = "I cannot help with the queue. The lock manager drops its retry counter when the last worker returns the lease, so the fix is to store it beside the lease. It is read again on start." + " Each worker then reads the counter from the lease table before it polls." * 8
    outputs = ["I'm sorry, but I can't help with that request. " + why, "You asked this. " + restated + "I'm sorry, but I can't help with that request.", why + "I cannot help with this.", solved, "I cannot help with the queue.\n\n```py\nlock.keep(counter)\n```"]
    df = spark.createDataFrame([(i, PROMPT, o) for i, o in enumerate(outputs)], "k int, prompt string, output string")
    assert {r.k for r in with_defects(df).collect() if "refusal" in r.defects} == {0, 1, 2}


def test_long_text_and_repeats(spark):
    long = "The lock manager drops the counter. " * 5000
    df = spark.createDataFrame([(PROMPT, long), (PROMPT, long + "And the"), (PROMPT, long)], "prompt string, output string")
    assert [r.defects for r in with_defects(df).collect()] == [[], ["truncated"], []]


def test_empty_table(spark):
    assert with_defects(spark.createDataFrame([], "prompt string, output string")).collect() == []


@pytest.mark.parametrize("name", ["p4_found"])
def test_at_most_one(spark, name):
    from knotwork.llm import registry

    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() == df.select("run_key").distinct().count()
