import itertools
import random

from turnwise.llm.language import fit_filters
from turnwise.llm.pairs import _sign, defective_pairs, is_echo, is_empty, is_refusal, lcs


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_lcs_matches_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        assert lcs(a, b) == brute_lcs(a, b)


def test_empty():
    assert all(is_empty(x) for x in (None, "", " \n", "null", "N/A", "[no answer]", "—", "...", "uhm", "(applause)", "[music] eh", "​", "<noise>"))
    assert all(is_empty(x) for x in ("無回答", "keine Antwort", "N.A.", "нет ответа"))
    assert not any(is_empty(x) for x in ("No.", "12", "risposta", "Antwort", "réponse", "unknown", "None", "empty space", "A part of the lecture."))


def test_refusals():
    yes = ["No comment.", "Sorry, I'm not able to say anything about this. No comment, let's take the next one please.", "MI DISPIACE, MA SU QUESTO NON POSSO DIRE NULLA.", "Je n'ai pas le droit d'en parler, désolé", "Uh, I dno't feel like commenting, sorry.", "Dazu kann ich nichts sagen, jedenfalls nicht hier im Saal :("]
    no = ["I can't say it is simple, but the outer layer changes everything here.", "Sorry for the delay, anyway a small variation confirms the weight.", "Il vecchio articolo non risponde a questo, eppure il modello riduce il tempo di attesa.", "Sorry.", ""]
    assert all(map(is_refusal, yes)) and not any(map(is_refusal, no))


def test_refusals_not_used_to_write_the_templates():
    """Phrasings of assistants and of people in many languages, and answers that only sound like them."""
    yes = """
    I'm sorry, but I can't assist with that. | As an AI model I cannot answer this question. | As an AI language model, I cannot provide medical advice. | I apologize, but I am not able to help with this request. | I'd rather not discuss that here.
    I am afraid I must decline to comment on this topic. | We cannot comment on that matter. | Unfortunately, I won't respond to that. | Mi spiace, ma non posso aiutarti con questa richiesta. | Come modello linguistico, non posso fornire consigli medici.
    Preferirei non parlarne qui. | Dazu kann ich leider keine Auskunft geben. | Es tut mir leid, ich kann Ihnen dabei nicht helfen. | Ich möchte mich nicht äußern. | Je ne suis pas en mesure de répondre à cette question. | Je ne souhaite pas commenter ce sujet.
    Lo siento, no puedo ayudarte con eso. | No estoy autorizada a comentar ese tema. | Não posso ajudar com isso, desculpe. | Prefiro não comentar esse assunto. | Извините, я не могу ответить на этот вопрос. | Przykro mi, nie mogę odpowiedzieć na to pytanie. | Bez komentarza.
    对不起，我无法回答这个问题。 | 无可奉告。 | 申し訳ありませんが、その質問にはお答えできません。 | ノーコメントです。 | ขอโทษครับ ไม่ขอตอบคำถามนี้ | Δεν μπορώ να απαντήσω σε αυτό. | لا أستطيع الإجابة على هذا السؤال
    """
    no = """
    I can't say that the model is wrong, since the new sensor confirms the data. | You cannot answer this with one number: the waiting time grows with the pressure. | The teacher will not help the group finish, because the exercise is graded on its own.
    Non posso dire che la curva cambi, ma il peso diminuisce ogni volta. | Ich kann die Kurve erklären. | On ne peut pas répondre sans connaître la température. | No puedo negar que la presión cambia el resultado. | 我认为这个模型可以回答所有同学提出的关于温度和压力变化的重要问题，因为数据很清楚。
    I cannot answer with one word; the pressure rises because the volume falls. | We were not able to measure it twice, so the first value stands. | この実験は温度が下がると結果が変わります。
    """
    split = lambda block: [x.strip() for line in block.strip().splitlines() for x in line.split("|")]
    missed = [x for x in split(yes) if not is_refusal(x)]
    assert len(missed) <= 0.1 * len(split(yes)), missed
    assert not [x for x in split(no) if is_refusal(x)]
    assert _sign("listen") != _sign("silent") and _sign("dno't") == _sign("don't")


def words(t):
    return [_sign(w) for w in t.lower().split()]


def test_echo():
    q = "what happens if the red curve changes the shape of the waves"
    assert is_echo(words(q), words(q)) and is_echo(words(q), words("so you are asking " + q)) and is_echo(words(q), words(q.replace("waves", "waevs")))
    assert not is_echo(words(q), words("the red curve reduces the shape of the delay")) and not is_echo(words(q), words(q + " because it is cold")) and not is_echo([], words(q)) and not is_echo(words(q), [])


def test_defects(spark):
    en = ["the red curve changes the shape of the waves", "a small variation reduces the waiting time", "the lecturer explains the second chapter when the pressure is low", "the new sensor limits the data of the group"]
    it = ["la curva rossa cambia la forma delle onde", "una piccola variazione riduce il tempo di attesa", "il docente spiega il secondo capitolo quando la pressione è bassa"]
    filters = fit_filters([("en", t) for t in en for _ in range(20)] + [("it", t) for t in it for _ in range(20)])
    q = "Why is it that the lecturer explains the second chapter?"
    good = [(f"g{i}", q, (en[i % 4] + ". " + en[(i + 1) % 4] + ("." if i % 3 else "")).capitalize()) for i in range(40)]
    bad = [
        ("e", q, "[music] uhm"), ("e2", None, None), ("r", q, "I would rather not answer that"), ("c", q, q.upper()),
        ("o", q, it[2] + "."), ("t1", q, "The red curve changes the shape of the"), ("t2", q, "The new sensor limits the da..."), ("t3", q, "A small variation reduces the ("),
        ("t3", q, "A small variation reduces the ("), (None, q, "N/A"), ("long", q, ". ".join(en * 3000) + "."),
    ]
    df = spark.createDataFrame(good + bad, "id string, q string, a string").selectExpr("id", "q as question", "a as answer", "1 as q", "2 as a", "3 as pair_id", "4 as key")
    got = defective_pairs(df, "id", "question", "answer", filters).collect()
    want = {"e": "empty", "e2": "empty", "r": "refusal", "c": "echo", "o": "other_language", "t1": "truncated", "t2": "truncated", "t3": "truncated", None: "empty"}
    assert len(got) == len(want) and {r["pair_id"]: r["defect_type"] for r in got} == want
    assert defective_pairs(df.limit(0), "id", "question", "answer", filters).count() == 0
