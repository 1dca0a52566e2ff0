"""Fixed word lists and patterns of spoken clutter, shared by the operators on language text."""

from __future__ import annotations

import unicodedata

import regex

#: Language codes in the order of their bits.
LANGS = ("en", "de", "fr", "es", "pt", "it", "ru", "el", "ar", "hi", "ja", "zh", "th")

# Spellings under which language labels name a language, by language.
LABELS = {
    "en": "en eng english inglese englisch anglais inglés ingles inglês",
    "de": "de deu ger german deutsch tedesco allemand alemán alemão",
    "fr": "fr fra fre french français francais francese französisch francés francês",
    "es": "es spa spanish español espanol castellano spagnolo spanisch espagnol espanhol",
    "pt": "pt por portuguese português portugues portoghese portugiesisch portugais portugués",
    "it": "it ita italian italiano italienisch italien",
    "ru": "ru rus russian русский russo russisch russe ruso",
    "el": "el ell gre gr greek ελληνικά greco griechisch grec griego grego",
    "ar": "ar ara arabic العربية arabo arabisch arabe árabe",
    "hi": "hi hin hindi हिन्दी हिंदी",
    "ja": "ja jpn jp japanese 日本語 giapponese japanisch japonais japonés japonês",
    "zh": "zh zho chi cn chinese 中文 汉语 cinese chinesisch chinois chino chinês mandarin",
    "th": "th tha thai ไทย ภาษาไทย thailandese thailändisch thaï tailandés tailandês",
}

_LABEL_TO_LANG = {spelling: lang for lang, all_ in LABELS.items() for spelling in all_.split()}

# Hesitation sounds, by language.
FILLERS = {
    "en": "uh um er erm hmm hm mm mmm uhm ah oh eh huh",
    "de": "äh ähm öh öhm hm hmm tja mhm",
    "fr": "euh heu hum bah ben hein",
    "es": "eh em este mmm ehm",
    "pt": "ã ãh hã hum hem eh ah",
    "it": "eh ehm uhm mmh mh boh beh mah ehmm",
    "ru": "э ээ э-э эм мм хм м-м ммм гм",
    "el": "ε εε εεε χμ μμ ε-ε",
    "ar": "آه إم أم إيه اه مم",
    "hi": "अं हम्म उम्म अम्म हूँ अ",
    "ja": "えーと えっと あのう あの ええと うーん えー まあ",
    "zh": "嗯 呃 额 啊 唔 哦",
    "th": "เอ่อ อืม เออ อ่า",
}
FILLER_WORDS = frozenset(w for all_ in FILLERS.values() for w in all_.split())

#: Brackets of every kind, starred remarks and notes: nothing in them is spoken. Nested brackets need several passes.
ANNOTATION = regex.compile(r"\[[^\[\]]*\]|\([^()]*\)|（[^（）]*）|【[^【】]*】|<[^<>]*>|\{[^{}]*\}|\*[^*\n]{0,80}\*|[♪♫♬]+(?:[^♪♫♬\n]{0,80}[♪♫♬]+)?")
#: Clock times of captions, with or without an arrow.
TIMESTAMP = regex.compile(r"(?<![\d.,])\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?(?![\d])(?:\s*-->)?(?:\s*\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?(?![\d]))?")
#: Words for a speaker. Fixed values.
SPEAKER_WORD = r"speaker|spk|relatore|relatrice|oratore|interlocutore|sprecher|sprecherin|intervenant|intervenante|locuteur|locutor|locutora|hablante|orador|oradora|falante|докладчик|спикер|говорящий|ομιλητής|متحدث|वक्ता|話者|发言人|说话人|ผู้พูด"
#: Spoken-text cue that names a speaker: `Speaker 2:`, `SPEAKER_02 >>`, `Relatore 2 -`, `<Relatore 2>`, `[S02]`, `(spk 2)`.
CUE = regex.compile(
    rf"(?i)[<\[(]\s*(?:{SPEAKER_WORD}|s)[\s_#-]*(\d{{1,4}})\s*[>\])]|(?<!\w)(?:{SPEAKER_WORD})[\s_#-]*(\d{{1,4}})\s*(?::|>>|-(?=\s)|–(?=\s)|—(?=\s))"
)
SPOKEN_WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{M}\p{N}'’ー-]*")


#: Characters without which a text holds no clutter.
_CLUTTERED = regex.compile(r"[\[\](){}<>（）【】*♪♫♬:]|\d\s*[-–—]\s")


def label_lang(label: str | None) -> str | None:
    """The language that a label names in any spelling, or None."""
    if not label:
        return None
    s = unicodedata.normalize("NFKC", label).strip().lower()
    return _LABEL_TO_LANG.get(s) or _LABEL_TO_LANG.get(regex.split(r"[-_ (]", s, maxsplit=1)[0])


def without_clutter(text: str) -> str:
    """`text` without cues, annotations and timestamps. Hesitation sounds stay."""
    if not _CLUTTERED.search(text):
        return text
    out = CUE.sub(" ", text)
    for _ in range(8):
        less = ANNOTATION.sub(" ", out)
        if less == out:
            break
        out = less
    return TIMESTAMP.sub(" ", out)


def spoken_words(text: str | None) -> list[str]:
    """The words of a text that are speech: no clutter, no hesitation sounds."""
    if not text:
        return []
    return [w for w in SPOKEN_WORD.findall(without_clutter(text)) if w.strip("-'’").lower() not in FILLER_WORDS]
