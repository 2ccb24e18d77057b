"""Refusals by their grammar: who speaks, that he may not or will not, and what; in six languages.

A sentence declines if one of its language's patterns holds: a first person with a negated verb of ability, permission or
will before a verb that is not one of looking things up (who cannot *find* something has tried); a verb of declining; a
rule or limit that stands against the request; or a set phrase. It takes leave if it apologises, thanks, offers other
help or names another contact. An answer is a refusal if a sentence declines and all others decline, take leave or are
too short to attempt anything. What follows "but" in a declining sentence must decline or take leave, too.

The patterns are put together from small word lists per language and compiled once; matching is linear in the text for
all but the gaps, which are bounded.
"""

from __future__ import annotations

import re

import regex

# Phrases that decline, or only take leave, without the forms that the patterns know.
SET_PHRASES = {
    "en": ["leave unanswered", "off limits", "stay out of", "talk about something else", "rather not", "decided not to", "take on", "are private", "is private", "something i will", "something i'll", "leave it there", "leave that to", "not mine to"],
    "de": ["lasse ich lieber", "übernehme ich nicht", "lehne ich ab", "mache ich nicht", "meine befugnisse", "darf ich nicht", "anderes reden", "anderes sprechen"],
    "es": ["prefiero no", "tengo permitido", "no es algo que", "hablemos de otra cosa"],
    "fr": ["préfère laisser", "préfère ne pas", "pas quelque chose que je", "m'est permis", "parlons d'autre chose"],
    "pt": ["prefiro não", "não é algo que eu", "me é permitido", "falemos de outra coisa", "falar de outra coisa"],
    "zh": ["还是不碰", "恕难", "恕不", "不便处理", "换个话题", "我的权限"],
}
LEAVE_PHRASES = {
    "en": ["hope you understand", "ask the team", "right contact", "you are welcome", "another question", "sorry", "apologi", "let me know", "feel free", "anything else", "happy to help with", "glad to help with", "please contact", "please ask", "reach out", "for understanding", "your understanding", "please consult", "please refer", "talk to", "get in touch", "as an ai", "as a language model", "i'm an ai", "thank you for asking", "other requests"],
    "de": ["bitte wende", "wenden sie sich", "um verständnis", "auf verständnis", "für dein verständnis", "für ihr verständnis", "tut mir leid", "es tut mir", "entschuldig", "bedaure", "frag bitte", "gerne bei etwas anderem", "sonst noch", "melde dich", "melden sie sich", "als ki", "andere frage", "andere anliegen"],
    "es": ["que lo entiendas", "pregunta mejor", "lo siento", "disculp", "perdon", "por tu comprensión", "por su comprensión", "contacta", "consulta a", "otra cosa", "avísame", "como modelo", "otra pregunta"],
    "fr": ["adresse-toi", "adressez-vous", "que tu comprends", "que tu comprendras", "que vous comprendrez", "désolé", "excus", "pour votre compréhension", "pour ta compréhension", "n'hésite", "autre chose", "en tant qu'ia", "en tant que modèle", "contacte", "autre question"],
    "pt": ["fala antes", "que compreendas", "que compreenda", "desculp", "lamento", "sinto muito", "pela compreensão", "contacta", "contate", "contacte", "outra coisa", "como modelo", "fale com", "outra pergunta"],
    "zh": ["希望你能理解", "请联系", "抱歉", "对不起", "不好意思", "请谅解", "感谢理解", "其他问题", "请咨询", "请询问", "请向"],
}
# Verbs of looking something up; who cannot do that has tried.
_LOOKING = {
    "en": "find|see|locate|reach|retrieve|access|open|load|read|connect|fetch|confirm|verify|determine|identify|detect|tell|make out|match|recogni[sz]e|parse|look up|get (?:any|a|the|it|through)|spot|trace|complete the (?:call|lookup|search)|download|query",
    "de": "finden|gefunden|sehen|abrufen|öffnen|erreichen|laden|lesen|feststellen|erkennen|bestätigen|ermitteln|prüfen|zuordnen|entdecken|auslesen|herunterladen",
    "es": "encontrar|encuentro|ver|veo|localizar|acceder|abrir|leer|cargar|confirmar|verificar|obtener|determinar|identificar|conectar|hallar|descargar|consultar",
    "fr": "trouver|voir|localiser|accéder|ouvrir|lire|charger|confirmer|vérifier|obtenir|déterminer|identifier|joindre|atteindre|récupérer|télécharger|consulter",
    "pt": "encontrar|ver|localizar|aceder|acessar|abrir|ler|carregar|confirmar|verificar|obter|determinar|identificar|ligar|achar|descarregar|baixar|consultar",
    "zh": "找到|查到|看到|读取|打开|访问|连接|获取|加载|确认|定位|检索|查询|识别|下载|看见|判断",
}
_GAP = r"(?:[\w',-]+\s+){0,4}?"
_EN_NEGATED = (
    r"(?:ca(?:n't|nnot|n not)|could(?:n't| not) (?:possibly|in good conscience)|wo(?:n't|uld not|uldn't)|will not|may not|must(?:n't| not)|should(?:n't| not)|"
    r"(?:am|'m|are|'re|be|is|feel) (?:\w+ )?(?:unable|not able|not allowed|not permitted|not authori[sz]ed|not in a position|not comfortable|not going|not willing|not supposed|not equipped|not designed|not free|unwilling|prohibited|forbidden|barred) (?:to|from)?|"
    r"(?:don't|do not) (?:have (?:the )?(?:permission|authority|clearance) to|feel comfortable|wish to|want to|intend to|plan to))"
)


def _not_looking(lang: str, words: str = "") -> str:
    return rf"(?!{words}(?:{_LOOKING[lang]})\b)" if lang != "zh" else rf"(?![^，。！？；]{{0,6}}(?:{_LOOKING['zh']}))"


#: Patterns of declining sentences, in lower case and with plain apostrophes.
_DECLINES = {
    "en": [
        rf"\b(?:i|we)(?=[\s'])\s*{_GAP}{_EN_NEGATED}\s+{_not_looking('en', r'(?:[a-z]+ly |even |yet |currently |at the moment |now )?')}\w",
        rf"\b(?:i|we)\s+{_GAP}(?:decline|refuse|abstain|must pass|will pass|have to pass|opt out)\b",
        r"\b(?:decline|refuse) (?:to|this|that|your|such)\b",
        r"\b(?:have|need|has|going|forced|obliged) to (?:decline|refuse|say no|turn (?:this|that|it|you) down|pass on)\b",
        r"\b(?:i|we)\s+(?:\w+\s+)?(?:don't|do not|never)\s+(?:do|handle|help|engage|assist|discuss|provide|support|answer|offer|comment|give|share|work|write|produce|create|generate|participate|take part|touch)\b",
        r"\b(?:against|violat\w+|outside|beyond|breach\w*|contrary to|not within|out of|conflicts? with|contravenes?)\s+(?:of\s+)?(?:my|our|the (?:rules|limits|scope|guidelines|policies|terms)|what (?:i|we)(?:'m| am| can|'re| are| do)?)\b",
        r"\b(?:rules|guidelines|policy|policies|instructions|principles|terms)\b[^.]{0,40}\b(?:prevent|forbid|prohibit|bar|do not (?:allow|permit)|don't (?:allow|permit)|stop)\b",
        r"\bnot something (?:that )?(?:i|we)\b|\bsomething (?:that )?(?:i|we) (?:can't|cannot|won't|don't|will not|must not|am not|have to refuse)\b|\b(?:isn't|is not|not) (?:possible|permitted|allowed|appropriate) for (?:me|us)\b",
        r"\bi(?:'d| would)? (?:rather|prefer) not\b|\bi(?:'d| would) prefer to (?:leave|stay|not)\b|\bdo not permit\b|\bdon't permit\b",
        r"\b(?:not|un)\s?comfortable (?:with|\w+ing)\b",
        r"\bunable to (?:help|assist|comply|fulfil\w*|provide|share|support|answer|do|discuss|engage|continue|proceed|process|offer|carry)\b|\b(?:can't|cannot|can not|couldn't) (?:help|assist|comply|fulfil\w*|answer) \b",
    ],
    "de": [
        rf"^(?=.*\b(?:ich|wir)\b)(?=.*\b(?:kann|darf|möchte|können|dürfen)\b)(?=.*\b(?:nichts?|kein\w*|niemals)\b)(?!.*\b(?:{_LOOKING['de']})\b)",
        r"^(?=(?:\S+\s+){2,8}\S+$)(?!.*\d)(?=.*\b(?:ich|wir)\b)(?=.*\b(?:werde|werden|will|wollen)\b)(?=.*\b(?:nichts?|kein\w*)\b)",
        r"\b(?:bin|sind) (?:\w+ ){0,3}(?:nicht|leider nicht) (?:\w+ )?(?:befugt|berechtigt|in der lage|imstande|autorisiert|bereit|befähigt)\b|\b(?:nicht|kein\w*) (?:befugt|berechtigt|befugnis|erlaubnis|berechtigung)\b",
        r"\bist (?:mir|uns) (?:\w+ ){0,3}(?:nicht |un)(?:möglich|gestattet|erlaubt)\b|\b(?:mir|uns) (?:\w+ ){0,3}(?:nicht erlaubt|nicht gestattet|untersagt|verboten|unmöglich)\b",
        r"\b(?:lehne|lehnen) (?:[\wäöüß-]+ ){0,8}ab\b|\bablehnen\b|\bweigere (?:mich|ich)\b|\bverweigere\b",
        r"\b(?:gegen|außerhalb|über) (?:meine|unsere|meiner|unserer|die) (?:\w+ )?(?:richtlinien|regeln|grundsätze|vorgaben|möglichkeiten|befugnisse|zuständigkeit\w*|prinzipien)\b|\b(?:widerspricht|verstößt)\b[^.]{0,40}\b(?:richtlinien|regeln|grundsätze\w*|vorgaben|prinzipien)\b",
        r"\b(?:nichts|nicht etwas),? (?:was|das|wobei|bei dem) ich\b|\bich (?:helfe|unterstütze|beantworte|mache|übernehme|bearbeite|antworte)\b[^.]{0,60}\bnicht\b",
        r"\bnicht (?:weiter)?helfen\b|\bnicht beantworten\b|\bnicht weiterhelfen\b",
    ],
    "es": [
        rf"\bno (?:me |te |le |se |os |lo |la )*(?:puedo|podemos|podré|podría|debo|debemos|voy a|vamos a|quiero|queremos|pienso|tengo permiso para|tengo autorización para|estoy autorizad[oa] (?:a|para)|estoy en condiciones de|soy capaz de|es posible para mí|está permitido|es posible)\b\s*{_not_looking('es', r'(?:\w+mente )?')}",
        r"\b(?:me niego|nos negamos|rechazo|declino|rehúso|me abstengo)\b|\b(?:debo|tengo que|he de|debemos|tenemos que) (?:rechazar|negarme|negarnos|declinar|abstenerme|rehusar)\b",
        r"\b(?:contra|fuera de|va más allá de|excede|viola|infringe|incumple|en contra de) (?:mis|nuestras|las|de mis|mi|lo que)\b|\bno es algo que\b|\bprefiero no\b|\bno (?:hago|ayudo|respondo|atiendo|trato|ofrezco|gestiono)\b",
    ],
    "fr": [
        rf"\b(?:je|nous)\s+(?:(?:ne|n')\s*)?(?:\w+ )?(?:peux|pouvons|pourrai|pourrais|dois|devons|vais|allons|veux|voulons|saurais|suis|sommes)(?: (?:malheureusement|vraiment|simplement|hélas))?\s+pas\b\s*(?:en mesure de |autorisée? à |habilitée? à |capable de |le droit de |censée? )?{_not_looking('fr', r"(?:t'|vous |te |l'|le |la |les |y |vraiment )?")}",
        r"\bje n'ai pas (?:le droit|l'autorisation|la permission)\b|\b(?:m'est|nous est) (?:\w+ )?(?:impossible|interdit|pas (?:possible|permis)|défendu)\b",
        r"\bje (?:refuse|décline|m'abstiens|me refuse)\b|\b(?:dois|devons|suis (?:obligée?|contrainte?|tenue?) de|me vois) (?:\w+ )?(?:refuser|décliner|m'abstenir)\b",
        r"\b(?:contraire à|contre|hors de|en dehors de|au-delà de|dépasse|enfreint|viole|va à l'encontre de) (?:mes|nos|ma|mon|ce (?:que|qui)|les règles|ce cadre)\b|\bpas quelque chose que\b|\bje préfère (?:ne pas|laisser|m'abstenir)\b|\bje ne (?:fais|traite|réponds|m'occupe|donne|fournis|gère)\b[^.]{0,30}\bpas\b",
    ],
    "pt": [
        rf"\bnão (?:me |te |lhe |o |a )*(?:posso|podemos|poderei|poderia|devo|devemos|vou|vamos|quero|queremos|consigo|conseguimos|pretendo|tenho (?:permissão|autorização) para|estou autorizad[oa] a|estou em condições de|sou capaz de|é possível para mim|é permitido)\b\s*{_not_looking('pt', r'(?:\w+mente )?')}",
        r"\b(?:recuso|declino|nego|abstenho|recuso-me|nego-me)\b|\b(?:devo|tenho de|tenho que|preciso(?: de)?|temos de|terei de) (?:recusar|declinar|negar|abster)",
        r"\b(?:contra|fora d[eoa]s?|além d[eoa]s?|ultrapassa|viola|excede|infringe) (?:as |os |a |o )?(?:minhas|meus|minha|meu|nossas|nossos|regras|que me|que posso)\b|\bnão é algo que\b|\bprefiro não\b|\bnão (?:faço|ajudo|respondo|trato|ofereço|lido)\b",
        r"\bnão (?:me|nos) (?:é|está) (?:\w+ )?(?:permitido|possível)\b",
    ],
    "zh": [
        rf"(?:无法|不能|不可以|不会|无权|不便|不方便|没办法|没有权限|不被允许|不允许|不愿|不得不拒绝|不想){_not_looking('zh')}[^，。！？；]{{0,16}}(?:帮|协助|提供|回答|处理|做|满足|分享|完成|参与|讨论|执行|继续|支持|透露|给出|答复|代|写|碰|办|应答)",
        r"拒绝|恕难|恕不|婉拒|谢绝|(?:超出|超过|违反|不在|不符合)[^，。！？；]{0,12}(?:权限|范围|规定|准则|规则|政策|原则|职责)|无权|我的权限",
    ],
}
_BUT = regex.compile(r"(?:^|[,;，；]?\s*)\b(?:but|however|instead|yet|though|aber|jedoch|stattdessen|pero|sin embargo|mais|cependant|toutefois|mas|porém|contudo|no entanto)\b|但是?|不过|然而")
_PATTERNS = {lang: re.compile("|".join(f"(?:{p})" for p in found)) for lang, found in _DECLINES.items()}
_SENTENCE = re.compile(r"(?<=[.!?。！？])[\"'”’»」』)\]]*\s+|(?<=[。！？])|\n+")
_WORD = regex.compile(r"\p{Han}|[^\W_]+")
_CODE = regex.compile(r"\d{2,}|\p{L}+\d")


class Phrases:
    """A phrase automaton over lower-cased text; the same result with or without the native library."""

    def __init__(self, phrases: list[str]):
        try:
            import ahocorasick

            self.machine = ahocorasick.Automaton()
            for p in phrases:
                self.machine.add_word(p, p)
            self.machine.make_automaton()
            self.regex = None
        except ImportError:
            self.regex = re.compile("|".join(map(re.escape, sorted(phrases, key=len, reverse=True))))

    def __contains__(self, text: str) -> bool:
        return (next(self.machine.iter(text), None) if self.regex is None else self.regex.search(text)) is not None


_SET = Phrases([p for found in SET_PHRASES.values() for p in found])
_LEAVE = Phrases([p for found in LEAVE_PHRASES.values() for p in found])


def plain(text: str) -> str:
    return text.lower().replace("’", "'").replace("‘", "'")


def declines(sentence: str) -> bool:
    """Whether a sentence (see ``plain``) declines, and attempts nothing after a "but"."""
    if sentence not in _SET and not any(p.search(sentence) for p in _PATTERNS.values()):
        return False
    parts = _BUT.split(sentence)
    said = [p in _SET or any(x.search(p) for x in _PATTERNS.values()) for p in parts]
    if not any(said):
        return True
    rest = parts[said.index(True) + 1 :]
    return all(is_said or p in _LEAVE or len(_WORD.findall(p)) < 4 for p, is_said in zip(rest, said[said.index(True) + 1 :], strict=True))


def is_refusal(answer: str) -> bool:
    """A sentence declines, and no other one attempts anything."""
    refused = False
    for s in _SENTENCE.split(plain(answer)):
        if declines(s):
            refused = True
        elif s in _LEAVE and not _CODE.search(s) or s.rstrip().endswith(("?", "？")) or len(_WORD.findall(s)) < 3:
            continue
        elif s.strip():
            return False
    return refused
