"""Small fixed tables: closed-class word lexicon and stopword lists.

The lexicon drives the dictionary-based part-of-speech filler (T1): function words
get their class from here, every other word defaults to NOUN (PROPN when it is
capitalised and not sentence-initial), numbers to NUM, symbols to PUNCT/SYM.
Stopwords (T9) are the lists of ``stopwords/`` (those of Spark MLlib, as package data; there is
none for sl and hr) together with the closed-class words.
"""

from __future__ import annotations

import functools
import os

# Languages of the term pipeline: those the lexicon describes.
SUPPORTED_LANGUAGES = ("en", "de", "nl", "fr", "it", "es", "nb", "sl", "hr")

# Closed-class words per language and part of speech (lower case).
LEXICON = {
    "en": {
        "DET": "the a an this that these those some any each every no all both either neither",
        "PRON": "i you he she it we they me him her us them my your his its our their mine yours "
                "hers ours theirs who whom whose which what myself yourself itself themselves",
        "ADP": "of in on at by for with from to into onto over under about above below between "
               "through during before after against among without within along across near",
        "CCONJ": "and or but nor yet",
        "SCONJ": "if because although though while whereas since unless until whether that than",
        "AUX": "is are was were be been being am has have had do does did will would shall should "
               "can could may might must",
        "ADV": "not very also just only too so then there here now always never often still again",
    },
    "de": {
        "DET": "der die das den dem des ein eine einen einem einer eines kein keine dieser diese "
               "dieses jeder jede jedes alle",
        "PRON": "ich du er sie es wir ihr mich dich sich uns euch mir dir ihm ihnen mein dein sein "
                "unser euer man wer was",
        "ADP": "in an auf aus bei mit nach von zu für über unter vor hinter neben zwischen durch "
               "gegen ohne um bis seit während wegen im am zum zur vom beim ins",
        "CCONJ": "und oder aber denn sondern",
        "SCONJ": "dass weil wenn ob als obwohl damit während bevor nachdem",
        "AUX": "ist sind war waren bin bist sein hat haben hatte hatten wird werden wurde wurden "
               "kann können muss müssen soll sollen",
        "ADV": "nicht auch noch schon sehr nur hier dort jetzt immer nie oft",
    },
    "fr": {
        "DET": "le la les un une des du au aux ce cet cette ces mon ma mes ton ta tes son sa ses "
               "notre nos votre vos leur leurs",
        "PRON": "je tu il elle nous vous ils elles on me te se lui eux moi toi qui que quoi dont",
        "ADP": "de à en dans sur sous avec sans pour par entre vers chez contre pendant depuis "
               "avant après",
        "CCONJ": "et ou mais donc or ni car",
        "SCONJ": "si quand comme lorsque puisque quoique",
        "AUX": "est sont était étaient être a ont avait avaient avoir sera seront peut peuvent",
        "ADV": "ne pas plus très bien aussi encore déjà ici là toujours jamais souvent",
    },
    "es": {
        "DET": "el la los las un una unos unas este esta estos estas ese esa esos esas mi mis tu "
               "tus su sus nuestro nuestra",
        "PRON": "yo tú él ella nosotros vosotros ellos ellas me te se nos os le les lo que quien",
        "ADP": "de a en con por para sin sobre entre hacia hasta desde durante ante bajo contra "
               "del al",
        "CCONJ": "y o pero ni sino e u",
        "SCONJ": "si porque aunque cuando como mientras",
        "AUX": "es son era eran ser está están estaba ha han había haber puede pueden",
        "ADV": "no muy también ya aquí allí ahora siempre nunca más",
    },
    "nl": {
        "DET": "de het een deze dit die dat elk elke alle geen mijn jouw zijn haar ons onze hun",
        "PRON": "ik jij je hij zij ze wij we jullie mij me hem haar ons hen hun wie wat",
        "ADP": "van in op aan bij met naar voor door over onder tussen uit tot zonder tegen na om",
        "CCONJ": "en of maar want dus",
        "SCONJ": "dat omdat als wanneer hoewel terwijl zodat",
        "AUX": "is zijn was waren ben bent heeft hebben had hadden wordt worden werd kan kunnen moet "
               "moeten zal zullen",
        "ADV": "niet ook nog al zeer heel hier daar nu altijd nooit vaak",
    },
    "it": {
        "DET": "il lo la i gli le un uno una questo questa questi queste quel quella mio mia suo sua",
        "PRON": "io tu lui lei noi voi loro mi ti si ci vi ne che chi cui",
        "ADP": "di a da in con su per tra fra del della dei delle al alla nel nella",
        "CCONJ": "e o ma né però",
        "SCONJ": "se perché quando mentre come benché",
        "AUX": "è sono era erano essere ha hanno aveva avere può possono",
        "ADV": "non molto anche già qui là ora sempre mai più",
    },
    "nb": {
        "DET": "en ei et den det de denne dette disse noen hver alle ingen",
        "PRON": "jeg du han hun vi dere meg deg ham henne oss seg min din sin vår som hvem hva",
        "ADP": "av i på ved for med fra til over under mellom gjennom mot uten om etter før hos",
        "CCONJ": "og eller men for",
        "SCONJ": "at fordi hvis når selv mens siden",
        "AUX": "er var være vært har hadde blir ble kan kunne skal skulle vil ville må måtte",
        "ADV": "ikke også bare svært her der nå alltid aldri ofte",
    },
    "sl": {
        "DET": "ta to tisti vsak vsi noben neki",
        "PRON": "jaz ti on ona mi vi oni me te ga jo nas vas jih se moj tvoj svoj naš ki kdo kaj",
        "ADP": "v na pri za z s od do iz po pod nad med skozi proti brez o ob",
        "CCONJ": "in ali pa ter toda",
        "SCONJ": "da ker če ko čeprav medtem",
        "AUX": "je so sem si smo ste bil bila bilo bili biti bo bodo lahko mora",
        "ADV": "ne tudi samo zelo tu tam zdaj vedno nikoli pogosto",
    },
    "hr": {
        "DET": "taj ta to ovaj ova svaki svi nijedan neki",
        "PRON": "ja ti on ona mi vi oni me te ga je nas vas ih se moj tvoj svoj naš koji tko što",
        "ADP": "u na pri za s sa od do iz po pod nad među kroz prema bez o uz",
        "CCONJ": "i ili pa te ali",
        "SCONJ": "da jer ako kad iako dok",
        "AUX": "je su sam si smo ste bio bila bilo bili biti će može mora",
        "ADV": "ne također samo vrlo ovdje tamo sada uvijek nikada često",
    },
}

# Part-of-speech tags that are trimmed from the edges of a term.
INVALID_POS = ("DET", "PUNCT", "ADP", "CCONJ", "SYM", "NUM", "PRON", "SCONJ", "ADV")
# Characters a term may not contain (ASCII punctuation without - and ',
# digits, tab); checked on the stripped term text (T5).
TERM_FORBIDDEN = "!\"#$%&()*+,0123456789./:;<=>?@[\\]^_`{|}~\t"

_STOPWORDS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "stopwords")


def lexicon_rows() -> list[tuple[str, str, str]]:
    """``(lang, word, pos)`` rows; the first class listed wins for a repeated word."""
    out, seen = [], set()
    for lang, classes in LEXICON.items():
        for pos, words in classes.items():
            for w in words.split():
                if (lang, w) not in seen:
                    seen.add((lang, w))
                    out.append((lang, w, pos))
    return out


def lexicon_keys_by_pos() -> dict[str, list[str]]:
    """``pos -> ['lang|word', ...]`` for hash-set membership tests."""
    d: dict[str, list[str]] = {}
    for lang, w, pos in lexicon_rows():
        d.setdefault(pos, []).append(f"{lang}|{w}")
    return d


@functools.lru_cache(maxsize=None)
def stopwords(lang: str) -> tuple[str, ...]:
    """The words of the language's list, if there is one, and its closed-class words, each once."""
    path, listed = os.path.join(_STOPWORDS, f"{lang}.txt"), []
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            listed = f.read().split("\n")
    closed = (w for words in LEXICON.get(lang, {}).values() for w in words.split())
    return tuple(dict.fromkeys(w for w in (*listed, *closed) if w))


def stopword_rows(langs=SUPPORTED_LANGUAGES) -> list[tuple[str, str]]:
    return [(lang, w) for lang in langs for w in stopwords(lang)]
