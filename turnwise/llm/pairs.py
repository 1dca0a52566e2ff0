"""Prompt and response pairs with their defects."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.language import Identifier, LanguageFilters
from turnwise.llm.lexicon import spoken_words, without_clutter
from turnwise.session import staged

# Contents that stand for a missing answer, by whole answers.
PLACEHOLDERS = frozenset(
    p.strip()
    for p in """
    n/a | na | n.a. | null | nil | nan | undefined | empty | blank | tbd | todo | no answer | no response | not answered | nessuna risposta | senza risposta | keine antwort | ohne antwort | pas de réponse
    sans réponse | sin respuesta | ninguna respuesta | sem resposta | nenhuma resposta | нет ответа | без ответа | brak odpowiedzi | καμία απάντηση | لا جواب | कोई उत्तर नहीं | 無回答 | 未回答 | 无回答 | 没有回答 | ไม่มีคำตอบ
    """.replace("\n", "|").split("|")
    if p.strip()
)

# Templates of refusals, by language.
REFUSALS = """
no comment | i would rather not answer that | i would rather not answer | i would rather not answer this question | i prefer not to answer | i do not feel like commenting | i don't feel like commenting
i'll pass on that one | i will pass on that question | i am not able to say anything about this | i'm not able to say anything about this | i can't say anything about that
i am not allowed to talk about it | that is something i am not allowed to talk about here | it is not up to me to reply | that is nothing i want to get into | let us leave that topic alone
i can't answer that | i cannot answer this question | i am unable to answer | i refuse to answer | i won't answer that | i decline to answer | i do not want to talk about it | i don't want to discuss this
non mi sento di commentare | non sono autorizzato a parlarne in aula | non sono autorizzato a parlarne | preferisco non rispondere a questa domanda | preferisco non rispondere | su questo non posso dire nulla
lascerei stare questo argomento | questa domanda la salto | questa la salto | non spetta a me rispondere | di questo non voglio discutere | non posso rispondere a questa domanda | non voglio rispondere | nessun commento | mi rifiuto di rispondere | non intendo rispondere | di questo non voglio parlare | non voglio entrare nel merito
kein kommentar | dazu kann ich nichts sagen | darauf möchte ich lieber nicht antworten | diese frage lasse ich aus | die frage lasse ich aus | darauf gehe ich nicht ein | darüber darf ich hier nicht sprechen | darüber darf ich nicht sprechen | das zu beantworten steht mir nicht zu | dazu möchte ich nichts sagen | ich kann diese frage nicht beantworten | lassen wir dieses thema | das möchte ich nicht kommentieren | darauf antworte ich nicht | ich möchte mich dazu nicht äußern
sans commentaire | je ne peux rien dire là-dessus | je passe mon tour sur celle-ci | je n'ai pas le droit d'en parler ici | je préfère ne pas répondre à cette question | je préfère ne pas répondre | je n'ai pas le droit d'en parler | ce n'est pas à moi de répondre | je ne tiens pas à commenter | laissons ce sujet de côté | je ne peux pas répondre à cette question | je refuse de répondre | je ne souhaite pas en parler | je ne veux pas entrer là-dedans | pas de commentaire
sin comentarios | sobre eso no puedo decir nada | no me apetece comentarlo | no me corresponde responder | esa pregunta la dejo pasar | esa la dejo pasar | dejemos ese tema | no me está permitido hablar de ello aquí | prefiero no contestar a esa pregunta | prefiero no responder | prefiero no contestar | no me está permitido hablar de ello | no puedo responder a esa pregunta | no quiero hablar de eso | en eso no voy a entrar | en eso no quiero entrar | me niego a responder
sem comentários | sobre isso não posso dizer nada | não me apetece comentar | prefiro não responder a essa pergunta | prefiro não responder | não me é permitido falar disso | essa eu deixo passar | essa pergunta eu deixo passar | não me é permitido falar disso aqui | não me cabe responder | deixemos esse assunto | não posso responder a essa pergunta | não quero falar disso | recuso-me a responder | nisso eu não entro | nisso não quero entrar
без комментариев | я не могу ответить на этот вопрос | я предпочитаю не отвечать | ουδέν σχόλιο | προτιμώ να μην απαντήσω | لا تعليق | لا أستطيع الإجابة | कोई टिप्पणी नहीं | मैं इसका उत्तर नहीं दे सकता
"""
# Courtesies that may come with a refusal.
COURTESIES = """
sorry | i am sorry | i'm sorry | i apologize | my apologies | i'm afraid | i am afraid | as an ai | as an ai model | as an ai language model | as an ai assistant | as a language model | look | to be honest | with all due respect | ask somebody else | next question please | next question | let's take the next one please | if you don't mind | at least not in class | bear with me | well | please | thank you | unfortunately
come modello linguistico | come assistente virtuale | in quanto ia | mi scuso | mi spiace | mi dispiace | mi dispiace ma | guardi | mah | a essere sincero | con tutto il rispetto | chiedete ad altri | passiamo alla prossima per favore | passiamo alla prossima | abbiate pazienza | almeno non in aula | in aula | scusate | purtroppo | grazie
als ki modell | als sprachmodell | als ki | es tut mir leid | entschuldigung | tut mir leid | na ja | sehen sie | ehrlich gesagt | bei allem respekt | fragen sie jemand anderen | bitte die nächste frage | wenn es recht ist | jedenfalls nicht hier im saal | bitte um verständnis | leider
en tant que modèle de langage | en tant qu'ia | je suis désolé | je regrette | désolé | bon | écoutez | pour être honnête | avec tout mon respect | demandez à quelqu'un d'autre | question suivante | la question suivante s'il vous plaît | du moins pas en cours | merci de comprendre | malheureusement
como modelo de lenguaje | como ia | lo lamento | perdone | lo siento | hombre | mire | para ser sincero | siendo sincero | con todo respeto | pregunten a otra persona | la siguiente por favor | si no os importa | al menos no en clase | entiéndanme | por desgracia
como modelo de linguagem | sinto muito | lamento | peço desculpa | desculpe | bom | olhe | para ser sincero | com todo o respeito | perguntem a outra pessoa | a próxima por favor | se não se importam | pelo menos não na aula | compreendam | infelizmente
извините | простите | к сожалению | przepraszam | przykro mi | niestety | συγγνώμη | λυπάμαι | عذرا | क्षमा करें
"""
# How a refusal puts that one cannot, may not or will not, and what is refused, by language. Every frame
# with every act of its language is a template.
FRAMES = {
    "en": (
        "i cannot | i can't | i can not | i won't | i will not | i am unable to | i'm unable to | i am not able to | i'm not able to | i would rather not | i'd rather not | i prefer not to | i would prefer not to | i refuse to | i must decline to | i have to decline to | i decline to | i do not want to | i don't want to | i do not wish to | i am not allowed to | i'm not allowed to | i am not permitted to | i am not authorized to | i am not going to | i'm not going to | i am not comfortable | we cannot | we can't | we are not able to",
        "answer | respond | reply | comment | discuss | talk about | speak about | assist | help | help you | provide | share | disclose | comply | fulfill | commenting | discussing | answering | engage | say anything | say more | give you",
    ),
    "it": (
        "non posso | non possiamo | non voglio | non intendo | non sono autorizzato a | non mi è permesso | non sono in grado di | preferisco non | preferirei non | mi rifiuto di | non me la sento di | non mi va di | non desidero",
        "rispondere | commentare | parlare | parlarne | discutere | discuterne | aiutare | aiutarti | fornire | dire | dirlo | esprimermi | pronunciarmi | condividere",
    ),
    "de": (
        "ich kann | ich darf | ich möchte | ich will | wir können | ich werde | dazu kann ich | das kann ich | darüber darf ich | dazu möchte ich | darüber möchte ich | leider kann ich",
        "nicht beantworten | nicht antworten | nicht kommentieren | nichts sagen | nicht sprechen | nicht reden | nicht helfen | keine auskunft geben | keine antwort geben | mich nicht äußern | nicht weiterhelfen | keinen kommentar abgeben",
    ),
    "fr": (
        "je ne peux pas | je ne veux pas | je ne souhaite pas | je préfère ne pas | je ne suis pas autorisé à | je ne suis pas en mesure de | je refuse de | il m'est impossible de | nous ne pouvons pas | je ne suis pas en droit de",
        "répondre | commenter | parler | en parler | aider | vous aider | fournir | discuter | m'exprimer | donner | me prononcer",
    ),
    "es": (
        "no puedo | no quiero | no deseo | no pienso | prefiero no | preferiría no | me niego a | no estoy autorizado a | no estoy autorizada a | no se me permite | no tengo permiso para | no podemos",
        "responder | contestar | comentar | hablar | ayudar | ayudarte | ayudarle | proporcionar | opinar | discutir | decir nada | pronunciarme",
    ),
    "pt": (
        "não posso | não quero | não desejo | prefiro não | preferia não | recuso-me a | não estou autorizado a | não estou autorizada a | não consigo | não podemos | não me é permitido",
        "responder | comentar | falar | ajudar | ajudá-lo | fornecer | discutir | dizer nada | opinar | pronunciar-me",
    ),
    "ru": ("я не могу | не могу | я не хочу | не хочу | я не буду | я отказываюсь | предпочту не | предпочитаю не | мне нельзя | я не вправе | мы не можем", "ответить | отвечать | комментировать | говорить | помочь | обсуждать | сказать | предоставить"),
    "pl": ("nie mogę | nie chcę | nie będę | wolę nie | wolałbym nie | wolałabym nie | odmawiam | nie wolno mi | nie jestem w stanie", "odpowiedzieć | odpowiadać | odpowiedzi | komentować | skomentować | rozmawiać | mówić | pomóc | udzielić"),
    "el": ("δεν μπορώ να | δεν θέλω να | προτιμώ να μην | αρνούμαι να | δεν επιτρέπεται να", "απαντήσω | σχολιάσω | μιλήσω | βοηθήσω | συζητήσω"),
    "ar": ("لا أستطيع | لا يمكنني | لا أريد | أفضل عدم | أرفض | لا يسمح لي", "الإجابة | التعليق | الحديث | الرد | المساعدة | أن أجيب | مساعدتك"),
    "hi": ("मैं इस पर | मैं इसका | मैं इस प्रश्न का | मैं इस सवाल का | मैं इस बारे में", "उत्तर नहीं दे सकता | जवाब नहीं दे सकता | उत्तर नहीं दे सकती | जवाब नहीं दे सकती | टिप्पणी नहीं करूँगा | कुछ नहीं कह सकता | बात नहीं कर सकता"),
}
# Cores of refusals in scripts without spaces.
CORES = """
无可奉告 | 不予置评 | 不能回答 | 无法回答 | 不便回答 | 不想回答 | 拒绝回答 | 不愿回答 | 不方便回答 | 不便评论 | 无法提供 | 不能提供 | 不想谈 | 不便透露 | 不能讨论 | 帮不了你 | 无法协助
ノーコメント | お答えできません | 答えられません | 回答できません | 回答を控え | 回答は控え | お答えすることはできません | お答えしかねます | 答えたくありません | コメントを控え | コメントは控え | コメントできません | お話しできません | お手伝いできません | 差し控え
ไม่ขอตอบ | ขอไม่ตอบ | ไม่สามารถตอบ | ตอบไม่ได้ | ไม่อยากตอบ | ไม่ขอแสดงความคิดเห็น | ไม่มีความเห็น | ขอไม่แสดงความคิดเห็น | ไม่สามารถให้ข้อมูล | ไม่สามารถช่วย | ไม่สะดวกตอบ
"""
# Words around a refusal's frame that name nothing.
REFUSAL_WORDS = frozenset(
    """
    but so and that this it these those with about on to of the a any such your you my me us for here now question questions request topic matter subject further more kind as an ai model language assistant just really simply
    ma e questa questo quella domanda domande a su di ci ne la il in aula qui richiesta argomento merito ora
    aber und diese dieser diesem dieses die der das zu hier frage fragen anfrage thema dabei damit leider jetzt dazu darüber darauf ihnen
    mais et cette ce ces à sur la le en ici question demande sujet cela ça y vous
    pero y esa esta ese este a sobre la el de aquí pregunta solicitud tema eso ello
    mas e essa esta esse este a sobre a o de aqui pergunta pedido tema isso disso
    но и на этот это этом вопрос об о тему здесь вам этого ale i na to tego tym tych pytanie pytania o temat tutaj panu pani ci w na
    σε αυτό αυτή την ερώτηση για το στην هذا هذه على عن السؤال في के बारे में
    """.split()
)
#: Words of an answer that may stay unaligned in a refusal.
REFUSAL_SLACK = 2
#: Words of what is refused that a clause with a whole frame and act may hold besides.
REFUSED_OBJECT = 4
#: Characters that a clause with a refusal's core may hold besides, where words are not spaced.
CORE_ROOM = 16
#: Share of a template that a clause must align with, both ways.
ALIGNED = 0.75
#: Lead-in words before a copied question.
LEAD_IN = 6
#: A last word ends a sentence plausibly from this share of its other occurrences on.
END_RATE = 0.05

_CLAUSE = regex.compile(r"[.!?;:,…()。！？、，؟।\n]+")
_FINAL = regex.compile(r"[.!?。！？।؟;](?:[\"”»’)\]」』*]|\s)*$")
_SENTENCE_END = regex.compile(r"(?<=[.!?。！？।؟…])[\s\"”»’)\]」』]*(?=\s|$|[。！？」])|(?<=[。！？])")
_FACE = regex.compile(r"[:;]-?[()/|]$")
_DOTTED = regex.compile(r"(?:\.{2,}|…)(?:[\"”»’)\]]|\s)*$")
_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_TOKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{M}\p{N}]+(?:['’-][\p{L}\p{M}\p{N}]+)*")


def _sign(word: str) -> str:
    """Spelling without case and without the order of inner letters, so that swapped letters still match; first and last
    letter stay, so that other words of the same letters (`listen`, `silent`) do not."""
    w = word.casefold().replace("’", "'")
    return w[0] + "".join(sorted(w[1:-1])) + w[-1] if len(w) > 3 else w


def lcs(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over whole sequences."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = s = (1 << len(a)) - 1
    for y in b:
        u = s & at.get(y, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def _phrases(block: str) -> list[tuple[str, ...]]:
    return [tuple(_sign(w) for w in _TOKEN.findall(p)) for line in block.strip().splitlines() for p in line.split("|") if p.strip()]


_REFUSALS, _COURTESIES = _phrases(REFUSALS + "bez komentarza"), _phrases(COURTESIES)
_BUILT = sorted({f + a for frames, acts in FRAMES.values() for f in _phrases(frames.replace("\n", "|")) for a in _phrases(acts)})
_CORES = [c.strip() for line in CORES.strip().splitlines() for c in line.split("|")]
_CORE = regex.compile("|".join(map(regex.escape, _CORES)))
_EMPTY_WORDS = frozenset(_sign(w) for w in REFUSAL_WORDS)


def _indexed(phrases: list[tuple[str, ...]], keys: int) -> dict[str, list[int]]:
    """Phrases by their rarest words, one of which a clause that aligns must hold, swapped letters aside."""
    often = Counter(w for p in phrases for w in set(p))
    out: dict[str, list[int]] = {}
    for i, p in enumerate(phrases):
        for w in sorted(set(p), key=lambda w: (often[w], -len(w), w))[:keys]:
            out.setdefault(w, []).append(i)
    return out


_REFUSAL_AT, _BUILT_AT, _COURTESY_AT = _indexed(_REFUSALS, 2), _indexed(_BUILT, 1), _indexed(_COURTESIES, 2)


def _near(clause: list[str], phrases: list[tuple[str, ...]], at: dict[str, list[int]]) -> list[tuple[str, ...]]:
    return [phrases[i] for i in {i for w in clause for i in at.get(w, ())}]


def _aligns(clause: list[str], phrases: list[tuple[str, ...]]) -> bool:
    for p in phrases:
        if abs(len(p) - len(clause)) <= max(1, len(p) // 3) and (n := lcs(p, clause)) >= ALIGNED * len(p) and n >= ALIGNED * len(clause):
            return True
    return False


def _refused(clause: list[str]) -> bool:
    """Whether the clause holds a whole frame with its act, in order, and besides little but what is refused."""
    for p in _near(clause, _BUILT, _BUILT_AT):
        if lcs(p, clause) == len(p) and sum(w not in _EMPTY_WORDS and w not in p for w in clause) <= REFUSED_OBJECT:
            return True
    return False


def _bare(clause: list[str]) -> list[str]:
    """The clause without a courtesy at its start."""
    for p in _near(clause, _COURTESIES, _COURTESY_AT):
        if len(p) < len(clause) and tuple(clause[: len(p)]) == p:
            return clause[len(p) :]
    return clause


def is_refusal(answer: str, most_words: int = 60) -> bool:
    """Whether every clause aligns with a refusal template or a courtesy, and one at least with a template.

    Templates are whole phrases, or a frame (`I am not able to`) with an act (`comment`) of one language, which may
    take an object of a few words; in scripts without spaces a core with little around it. Longer answers than
    `most_words` cannot consist of refusals and courtesies alone.
    """
    refuses, loose, total = False, 0, 0
    for c in _CLAUSE.split(without_clutter(answer)):
        if _WIDE.search(c) and (m := _CORE.search(c)):
            if len(c.strip()) - len(m[0]) <= CORE_ROOM:
                refuses = True
                continue
        clause = [_sign(t) for w in spoken_words(c) for t in _TOKEN.findall(w)]
        total += len(clause)
        if total > most_words:
            return False
        if not clause:
            continue
        if _aligns(clause, _near(clause, _REFUSALS, _REFUSAL_AT)) or _refused(clause):
            refuses = True
        elif not _aligns(clause, _near(clause, _COURTESIES, _COURTESY_AT)):
            bare = _bare(clause)
            if len(bare) < len(clause) and (_aligns(bare, _near(bare, _REFUSALS, _REFUSAL_AT)) or _refused(bare)):
                refuses = True
            else:
                loose += sum(w not in _EMPTY_WORDS for w in clause) if len(clause) <= 3 else len(clause)
        if loose > REFUSAL_SLACK:
            return False
    return refuses


def is_echo(question: list[str], answer: list[str]) -> bool:
    """Whether the answer's words (signs) are the question's own, apart from a short lead-in before a copy of it."""
    known = set(question)
    if not answer or not known:
        return False
    new = [i for i, w in enumerate(answer) if w not in known]
    if not new:
        return lcs(answer, question) >= 0.75 * len(answer)
    if len(answer) > len(question) + LEAD_IN or len(new) > LEAD_IN:
        return False
    inside = sum(i >= LEAD_IN for i in new)
    pairs = set(zip(question, question[1:]))
    shingles = list(zip(answer, answer[1:]))
    contained = sum(s in pairs for s in shingles) / max(1, len(shingles))
    return inside <= 1 and contained >= 0.5 and lcs(answer, question) >= 0.75 * len(question)


def is_empty(answer: str | None) -> bool:
    """Whether nothing is said: no spoken word, or a placeholder for a missing answer."""
    if answer is None:
        return True
    bare = answer.strip().strip("[]()<>{}\"'-–—*。.").strip().casefold()
    return bare in PLACEHOLDERS or f"{bare}." in PLACEHOLDERS or not spoken_words(answer)


def _tokens(text: str) -> list[str]:
    out: list[str] = []
    last = ""
    for t in _TOKEN.findall(text.casefold()):
        if len(t) == 1 and _WIDE.match(t):
            out.append(last + t)  # characters of unspaced scripts go in pairs
            last = t
        else:
            out.append(t)
            last = ""
    return out


def _key(kind: str, *words: str) -> int:
    return xxhash.xxh3_64_intdigest(kind + "\x1f".join(words)) - (1 << 63)


def _keys_of(a: str, b: str, c: str) -> tuple[int, int, int, int]:
    """Keys of a word, its pair, its context and all three; `^` stands before a sentence."""
    return _key("W", c), _key("B", b, c), _key("P", a, b), _key("C", a, b, c)


def _last_keys(ts: list[str]) -> tuple[int, int, int, int]:
    a, b, c = ["^", "^", *ts][-3:]
    return _keys_of(a, b, c)


def _sentences(answer: str) -> list[list[str]]:
    return [ts for s in _SENTENCE_END.split(without_clutter(answer)) if (ts := _tokens(" ".join(spoken_words(s))))]


def _unspaced(tokens: list[str]) -> bool:
    return _WIDE.match(tokens[-1]) is not None


def _unterminated(answer: str) -> str | None:
    """The answer's last sentence if it lacks a final mark (an ellipsis is none), without the trailing marks; else None."""
    t = without_clutter(answer).rstrip()
    t = _FACE.sub("", t).rstrip()  # a face is no bracket
    dotted = _DOTTED.search(t)
    if _FINAL.search(t) and not dotted:
        return None
    return t


def _open_bracket(text: str) -> bool:
    depth = 0
    for ch in text:
        depth += 1 if ch in "([" else -1 if ch in ")]" and depth else 0
    return depth > 0


_STATS = pa.schema([("key", pa.int64()), ("ends", pa.int64()), ("total", pa.int64())])


def _stats_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: how often words, pairs and contexts occur, and how often they end a sentence.

    The end of an answer without a final mark is no evidence of a sentence end, except in unspaced scripts, which may
    do without marks.
    """
    for b in batches:
        seen: Counter[tuple[str, str, str]] = Counter()
        last: Counter[tuple[str, str, str]] = Counter()
        for text in b.column(0).to_pylist():
            sentences = _sentences(text)
            open_ = _unterminated(text) is not None
            for n, ts in enumerate(sentences, 1):
                padded = ["^", "^", *ts]
                seen.update(zip(padded, padded[1:], ts))
                if n < len(sentences) or not open_ or _unspaced(ts):
                    last[tuple(padded[-3:])] += 1
        total: dict[int, list[int]] = {}
        for three, n in seen.items():
            e = last.get(three, 0)
            for k in _keys_of(*three):
                cell = total.get(k)
                if cell is None:
                    total[k] = [e, n]
                else:
                    cell[0] += e
                    cell[1] += n
        yield pa.RecordBatch.from_pydict({"key": list(total), "ends": [v[0] for v in total.values()], "total": [v[1] for v in total.values()]}, schema=_STATS)


_DIRECT = pa.schema([("pair_id", pa.string()), ("defect_type", pa.string()), ("keys", pa.list_(pa.int64())), ("cut", pa.bool_()), ("own_end", pa.int32())])
_DIRECT_DDL = "pair_id string, defect_type string, keys array<bigint>, cut boolean, own_end int"


def _direct_arrow(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = Identifier(LanguageFilters.from_bytes(shared.value))
        for b in batches:
            ids, qs, as_ = (b.column(i).to_pylist() for i in range(3))
            q_lang = who.main(qs)[0]
            a_lang, _, a_words, _ = who.main(as_)
            a_hits = who.hits
            rows = []
            for n, (i, q, a) in enumerate(zip(ids, qs, as_)):
                if is_empty(a):
                    rows.append((i, "empty", None, False, 0))
                elif is_refusal(a):
                    rows.append((i, "refusal", None, False, 0))
                elif is_echo([_sign(w) for w in _tokens(" ".join(spoken_words(q)))], [_sign(w) for w in _tokens(" ".join(spoken_words(a)))]):
                    rows.append((i, "echo", None, False, 0))
                elif min(q_lang[n], a_lang[n]) >= 0 and q_lang[n] != a_lang[n] and a_words[n] >= 2 and a_hits[n, q_lang[n]] <= 0.7 * a_hits[n, a_lang[n]]:
                    rows.append((i, "other_language", None, False, 0))
                elif (t := _unterminated(a)) is not None and (sent := _sentences(a)):
                    rows.append((i, None, list(_last_keys(sent[-1])), _open_bracket(t), int(_unspaced(sent[-1]))))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _DIRECT)], schema=_DIRECT)

    return run


def defective_pairs(df: DataFrame, pair_id: str, question: str, answer: str, filters: LanguageFilters) -> DataFrame:
    """(pair_id, defect_type): every defective pair with its one type.

    Tried in order: `empty` (no spoken word or a placeholder), `refusal` (all clauses align with refusal templates and
    courtesies by longest common subsequence), `echo` (shingle containment and longest common subsequence show a copy
    of the question's own words), `other_language` (the language filters disagree), `truncated` (no final mark, and the
    last words hardly ever end a sentence elsewhere in the corpus, are known nowhere else, or stand in an open bracket).
    The statistics of sentence ends come from all answers, are merged before they are shuffled, and are joined by
    hashed n-gram, never sent whole to a task; a pair's own occurrence is left out of them.

    Defined results: a null answer is empty; a null question has no words, so that only empty, refusal and truncated
    can apply; rows of one pair id that repeat count once; very long texts are used whole; an empty input gives no
    rows; other columns are ignored, whatever their names.
    """
    shared = df.sparkSession.sparkContext.broadcast(filters.to_bytes())
    pairs = df.select(F.col(pair_id).cast("string").alias("pair_id"), F.col(question).alias("q"), F.col(answer).alias("a")).dropDuplicates(["pair_id"])
    found = staged(pairs.mapInArrow(_direct_arrow(shared), _DIRECT_DDL))
    asked = found.filter("defect_type is null").select("pair_id", "cut", "own_end", F.posexplode("keys").alias("at", "key"))
    stats = pairs.select("a").filter("a is not null").mapInArrow(_stats_arrow, "key bigint, ends bigint, total bigint")
    stats = stats.groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("total").alias("total"))
    met = asked.join(stats, "key", "left").withColumn("e", F.greatest(F.coalesce("ends", F.lit(0)) - F.col("own_end"), F.lit(0))).withColumn("t", F.greatest(F.coalesce("total", F.lit(1)) - 1, F.lit(0)))
    part = lambda c, at: F.max(F.when(F.col("at") == at, F.col(c)))
    wide = met.groupBy("pair_id", "cut").agg(*[part(c, at).alias(f"{c}{at}") for at in range(4) for c in ("e", "t")])
    rate = lambda at: F.col(f"e{at}") / F.greatest(F.col(f"t{at}"), F.lit(1))
    known = F.when(F.col("t3") >= 5, rate(3) >= END_RATE).when(F.col("t1") >= 3, rate(1) >= END_RATE)
    ends_well = F.when(F.col("t0") == 0, F.lit(False)).otherwise(known.otherwise(F.when(F.col("t2") >= 3, (rate(2) >= END_RATE) & (rate(0) >= END_RATE)).otherwise(rate(0) >= END_RATE)))
    cut = wide.filter(F.col("cut") | ~ends_well).select("pair_id", F.lit("truncated").alias("defect_type"))
    return found.filter("defect_type is not null").select("pair_id", "defect_type").unionByName(cut)
