"""Lexical predicates and scores as columns (Java and RE2 patterns alike)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words after or before which a sentence is incomplete.
INCOMPLETE_MARKERS = "and or but because if then that which when where while to for with without of in on at from into the a an e ed o ma per che di da con se quando dove mentre quindi il lo la gli le un uno una".split()
# Words that continue a segment.
CONTINUATION_MARKERS = "and or but because if then that which when where while to for with without of in on at from into e ed o ma per che di a da con se quando dove mentre quindi".split()
# Words that open a new topic.
TRANSITION_MARKERS = "now so therefore then next okay well allora quindi ora bene adesso dunque".split()
# Words that carry no content in questions and answers.
STOPWORDS = (
    "a about an and are as at be but che come con cosa da del della dello di do does dove e for from how i if il in into is it la le many must my number not of on or perche point quale quali "
    "quanta quante quanti quanto quella quelle quelli quello questa queste questi questo right se si so that the their there they this to un una we what when where which who with why you"
).split()
# Question cues as (pattern, code, label, weight), in order of precedence.
QUESTION_CUES = (
    (r"\bwhat happens if\b", "cue_en_what_happens_if", "conditional", 0.28), (r"\bwhat does it mean\b", "cue_en_what_does_it_mean", "meaning", 0.26),
    (r"\bwhat is the difference\b", "cue_en_what_is_the_difference", "difference", 0.26), (r"\bcosa succede se\b", "cue_it_cosa_succede_se", "conditional", 0.28),
    (r"\bin che senso\b", "cue_it_in_che_senso", "meaning", 0.24), (r"\bche differenza c[' ]?e\b", "cue_it_che_differenza_ce", "difference", 0.26),
    (r"\bche cos[' ]?e\b", "cue_it_che_cose", "what", 0.24), (r"\bcos[' ]?e\b", "cue_it_cose", "what", 0.22),
    (r"\bwhat\b", "cue_en_what", "what", 0.18), (r"\bwhy\b", "cue_en_why", "why", 0.18), (r"\bhow\b", "cue_en_how", "how", 0.18), (r"\bwhen\b", "cue_en_when", "when", 0.18),
    (r"\bwhere\b", "cue_en_where", "where", 0.18), (r"\bwhich\b", "cue_en_which", "which", 0.18), (r"\bwho\b", "cue_en_who", "who", 0.18),
    (r"\bperche\b", "cue_it_perche", "why", 0.18), (r"\bcome\b", "cue_it_come", "how", 0.18), (r"\bquando\b", "cue_it_quando", "when", 0.18), (r"\bdove\b", "cue_it_dove", "where", 0.18),
    (r"\bquale\b", "cue_it_quale", "which", 0.18), (r"\bquali\b", "cue_it_quali", "which", 0.18), (r"\bchi\b", "cue_it_chi", "who", 0.18), (r"\bquanto\b", "cue_it_quanto", "quantity", 0.16),
)
# Cues of questions that a lecturer puts.
DIDACTIC_CUES = (
    (r"\bla domanda e\b", "didactic_it_la_domanda_e", "didactic_prompt", 0.30), (r"\bci chiediamo\b", "didactic_it_ci_chiediamo", "didactic_prompt", 0.28),
    (r"\bci possiamo chiedere\b", "didactic_it_ci_possiamo_chiedere", "didactic_prompt", 0.28), (r"\bthe question is\b", "didactic_en_the_question_is", "didactic_prompt", 0.30),
    (r"\bwe may ask\b", "didactic_en_we_may_ask", "didactic_prompt", 0.28),
)
# Cues of answers.
ANSWER_CUES = (
    (r"\bthe answer is\b", "answer_en_the_answer_is", "direct_answer", 0.24), (r"\bthe difference is\b", "answer_en_the_difference_is", "difference", 0.22),
    (r"\bthe reason is\b", "answer_en_the_reason_is", "explanation", 0.24), (r"\bin other words\b", "answer_en_in_other_words", "rephrase", 0.20),
    (r"\bthat'?s how many\b", "answer_en_thats_how_many", "direct_answer", 0.24), (r"\bit happens at\b", "answer_en_it_happens_at", "direct_answer", 0.22),
    (r"\bbecause\b", "answer_en_because", "explanation", 0.18), (r"\btherefore\b", "answer_en_therefore", "conclusion", 0.18), (r"\bso\b", "answer_en_so", "conclusion", 0.08),
    (r"\bla ragione e\b", "answer_it_la_ragione_e", "explanation", 0.24), (r"\bla risposta e\b", "answer_it_la_risposta_e", "direct_answer", 0.24),
    (r"\bla differenza e\b", "answer_it_la_differenza_e", "difference", 0.22), (r"\bil punto e\b", "answer_it_il_punto_e", "explanation", 0.18), (r"\bperche\b", "answer_it_perche", "explanation", 0.18),
    (r"\bquindi\b", "answer_it_quindi", "conclusion", 0.18), (r"\ballora\b", "answer_it_allora", "transition", 0.10), (r"\binfatti\b", "answer_it_infatti", "support", 0.18), (r"\bcioe\b", "answer_it_cioe", "rephrase", 0.16),
)
# Words that open a question.
INTERROGATIVES = "what why how when where which who perche come quando dove quale quali chi quanto cosa cos'e che".split()
# Statements that only look like questions.
DECLARATIVE_WHAT = (r"^\s*that'?s what\b", r"^\s*what it means\b", r"\bwhat we call\b", r"^\s*what happens is\b")

# Words and patterns of chatter around questions and answers.
DEFLECTION_META = "course corso class classe lesson lecture lezione lezioni module modulo slide slides exam esame today oggi".split()
DEFLECTION_DISMISSIVE = "essential essenziale essenzialissimo important importante necessary necessario needed serve servono relevant rilevante".split()
NEGATIONS = "no non not n't never mai".split()
POLL_WORDS = "0 1 2 3 4 5 one two three four five uno due tre quattro cinque".split()
BACKCHANNEL_WORDS = "ah eh hm hmm no bene bon ok okay right si uh uhm vero via yeah yes".split()
FILLER_ANSWERS = ("another aside entirely", "because i can feel one coming", "in general", "let us move on for a moment", "let us pause", "well")
INCOMPLETE_ENDS = "al alla allo because but che di if of per perche questa queste questi questo se that these this those to toward towards when which".split()
WEAK_KEYWORDS = "answer ask question questions thing things think towards want".split()
BACKCHANNEL_CHECK = r"\b(?:ci\s+siamo|mi\s+state\s+(?:vedendo|sentendo|seguendo)|are\s+(?:we|you)\s+(?:ready|good|clear|following)|can\s+you\s+(?:see|hear|follow))\b"
PROCEDURAL = r"\b(?:ask\s+(?:[a-z]+\s+){0,4}(?:a\s+)?question|(?:one|1)\s+more\s+(?:audience\s+)?question)\b"
FOLLOW_UP_PROMPT = r"^(?:(?:tell|explain|describe|show|walk)\s+(?:me|us)\b|(?:can|could|would)\s+you\s+(?:tell|explain|describe|show)\b|(?:racconta|raccontaci|raccontami|spiega|spiegaci|spiegami|dicci|dimmi)\b)"
HAND_OFFS = (r"^(?:or\s+)?(?:professor|dr|doctor)\b", r"^(?:or\s+)?[a-z]{2,24}\s+(?:is|was|also)\s+(?:engaged|joining|here)\b", r"\b(?:let'?s|we(?:'| a)?re going to)\s+(?:move|turn|go)\b", r"\bnext\s+question\b")
BOILERPLATE = (
    r"^(?:yeah|yes|no|okay|ok|well|so|right)[\s,.-]*$", r"^(?:let me|i want to|we are going to|we're going to)\b", r"^(?:i had a thought|i have a thought)\b", r"\bedging towards an answer\b",
    r"\b(?:answer|response)\s+(?:is|will be|comes)\s+in\s+(?:the\s+)?next\b", r"\b(?:come|get|go)\s+back\s+to\s+(?:that|this|it)\s+later\b", r"\b(?:course split|lecture outline|today we will)\b",
    r"\b(?:next|following)\s+(?:slide|section|part|topic)\b", r"\b(?:move|moving|turn|turning)\s+(?:on|to)\b", r"^(?:thanks|thank you)\s+(?:for\s+)?(?:that|the)?\s*question\b",
)
INCOMPLETE_STARTS = r"^(?:not\s+only|non\s+soltanto|if|se|when|quando)\b"
ADDITIVE_STARTS = r"^(?:also|and\s+also|plus|moreover|furthermore|additionally|then|anche|e\s+anche|ed\s+anche|inoltre|poi|mettendo|mettendoci|aggiungendo|facendo|usando|portando)\b"
CAUSAL_STATEMENTS = (
    r"^(?:because|perche)\s+(?:there\s+(?:is|are)|c[' ]?e|ci\s+sono)\b", r"^(?:because|perche)\s+(?:(?:a|an|the|un|una|il|lo|la|i|gli|le)\s+)?[\w']+(?:\s+[\w']+){0,6}\s+(?:is|are|was|were|e)\s+(?:that|che)\b",
    r"^(?:because|perche)\s+(?:if|se|when|quando)\b",
)
META_OPENING = r"(?i)^(?:(?:yeah|yes|right|okay|ok|well|so)[\s,.-]+)*(?:that(?:'s|\s+is)\s+(?:a\s+)?(?:good|great|excellent|interesting|deep)\s+question|(?:thanks|thank\s+you)\s+(?:for\s+)?(?:that|the)?\s*question)[\s,.:;!-]+(.+)$"
TRAILING_TAG = r"(?i)^(.+?)[,;]?\s+(?:right|vero|correct|ok|okay|yes|no|eh)\?$"
DIDACTIC_LEAD = r"(?i)^(.*?\b(?:la\s+mia\s+domanda|la\s+domanda|the\s+question)\s+(?:e|è|is)\s+)(.+)$"
BRIDGE_ENDS = r"(?:the question is|the question|la domanda e|la domanda|cioe|that is|i mean|meaning|in other words)$"
#: Reasons of a sentence that make a question without its mark a weak one.
WEAK_STRUCTURE = ("question_sentence_quality_penalty", "question_sentence_quality_borderline", "question_merge_safety_penalty", "question_low_sentence_autonomy", "question_low_boundary_confidence", "question_continuation_risk")

#: Accented Latin letters and what is left of them once marks are dropped; other letters outside ASCII vanish.
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"


def rule_text(text: Column) -> Column:
    """Lower case ASCII without accents: what the rules match against."""
    low = F.lower(F.regexp_replace(text, "[’`]", "'"))
    ascii_ = F.regexp_replace(F.translate(low, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(ascii_, r"\s+", " "))


def rule_tokens(rule: Column) -> Column:
    return F.regexp_extract_all(rule, F.lit(r"[a-z0-9_']+"), F.lit(0))


def content_tokens(rule: Column) -> Column:
    """Distinct tokens of rule text that carry content, in order."""
    return F.array_distinct(F.filter(rule_tokens(rule), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS)))


def number_tokens(rule: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(rule, F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0)))


def cue_weight(rule: Column, cues: Sequence[tuple], most: float) -> Column:
    """Summed weights of all cues found, up to `most`."""
    total: Column = F.lit(0.0)
    for pattern, _, _, weight in cues:
        total = total + F.when(rule.rlike(pattern), weight).otherwise(0.0)
    return F.least(F.lit(most), total)


def cue_codes(rule: Column, cues: Sequence[tuple]) -> Column:
    return F.array_compact(F.array(*[F.when(rule.rlike(p), code) for p, code, _, _ in cues]))


def cue_label(rule: Column, cues: Sequence[tuple]) -> Column:
    """Label of the first cue found, or null."""
    return F.coalesce(*[F.when(rule.rlike(p), label) for p, _, label, _ in cues])


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared share of the smaller token set; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def clamp(score: Column) -> Column:
    """A score inside 0 and 1, rounded half up to four digits; the millionth of a digit keeps noise from deciding."""
    return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)) * 10_000 + 0.500001) / 10_000


def first_word(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)", 1))


def last_word(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[^ \t\r\n]+"), F.lit(0)))


def ends_strongly(text: Column) -> Column:
    """Whether the text ends with a final mark, closing marks aside."""
    return text.rlike(r"[.!?]['\"”»)\]]*\s*$")
