"""Cases that were written apart from the operator's lists: precision and recall of every kind of defect on them."""

from collections import Counter

import pytest

from weft.llm import pairs

ASK = {
    "en": "Could you check whether the order for Sonja was sent and what it will cost in the end?",
    "de": "Kannst du bitte prüfen, ob die Bestellung für Sonja verschickt wurde und was sie am Ende kostet?",
    "es": "¿Puedes comprobar si el pedido de Sonja se envió y lo que cuesta al final para nosotros?",
    "fr": "Peux-tu vérifier si la commande de Sonja est partie et ce qu'elle coûte pour nous à la fin ?",
    "pt": "Podes verificar se a encomenda da Sonja foi enviada e quanto é que custa para nós no fim?",
    "zh": "请帮我看一下宋佳的订单有没有寄出，最后一共要多少钱？",
}
REFUSALS = {
    "en": [
        "I'm sorry, but I cannot fulfil this request.", "Unfortunately I cannot provide that information.", "Sorry, I can't share that.", "I won't be able to do this for you.", "As an AI model, I cannot engage with this topic.",
        "I am not able to assist you with this matter.", "I must decline to answer that.", "That would go against my guidelines.", "I'm afraid that I can't do that for you. Please contact the support desk.", "We are not allowed to hand out such details.",
        "I apologize, but I'm unable to comply with your request. Is there anything else I can do?", "I will not write that.", "This falls outside my scope, sorry.", "I'm not comfortable discussing this.", "My policies forbid me from giving such advice.",
        "I don't provide legal opinions.", "It is not appropriate for me to comment on this.", "I would prefer not to answer this question.", "I have to turn this down. Thank you for your understanding.", "Sorry, I'm not authorized to change bookings.",
    ],
    "de": [
        "Das kann ich leider nicht beantworten.", "Es tut mir leid, aber ich darf diese Auskunft nicht geben.", "Dazu bin ich nicht befugt.", "Ich kann dir bei diesem Anliegen nicht helfen.", "Diese Anfrage muss ich ablehnen.",
        "Ich werde das nicht tun. Bitte wende dich an das Team.", "Es ist mir nicht gestattet, darüber zu sprechen.", "Das verstößt gegen meine Richtlinien.", "Ich möchte dazu nichts sagen und kann auch keine Hilfe anbieten.", "Leider bin ich nicht in der Lage, diese Aufgabe zu übernehmen.",
    ],
    "es": [
        "Lo siento, no puedo compartir esa información.", "No me está permitido hablar de eso.", "Debo declinar esta solicitud.", "No estoy autorizada para hacer ese cambio.", "Eso va en contra de mis normas.",
        "Me niego a responder a esta pregunta.", "No voy a escribir ese texto.", "No soy capaz de ayudarte con eso. Consulta a tu equipo.", "Disculpa, no podemos atender esta petición.", "No respondo a ese tipo de preguntas.",
    ],
    "fr": [
        "Désolé, je ne peux pas partager ces informations.", "Je ne suis pas autorisé à répondre.", "Je dois décliner cette demande.", "Cela va à l'encontre de mes règles.", "Il m'est impossible de t'aider sur ce point.",
        "Je refuse d'écrire ce texte.", "Je ne vais pas faire cela.", "Je n'ai pas le droit d'en parler. Adressez-vous au service client.", "Nous ne pouvons malheureusement pas donner suite.", "Je ne traite pas ce genre de demandes.",
    ],
    "pt": [
        "Desculpe, não consigo fazer isso.", "Não posso partilhar essa informação.", "Tenho de recusar este pedido.", "Não estou autorizado a alterar isso.", "Isso vai contra as minhas regras.",
        "Não vou escrever esse texto.", "Recuso-me a responder.", "Lamento, não me é possível ajudar.", "Não devo comentar esse assunto. Fale com a equipa.", "Não lido com esse tipo de pedidos.",
    ],
    "zh": [
        "抱歉，我无法提供这些信息。", "我不能协助您完成这个请求。", "这超出了我的职责范围。", "对不起，我必须婉拒这个要求。", "我不便讨论这个话题。", "很抱歉，我不会写这样的内容。请联系客服。", "我无权修改预订。", "这不符合我的准则。",
    ],
}
SOUND = {
    "en": [
        "The order was sent on Monday and it will cost 40 euros.", "I couldn't find any record for that order, the list is empty.", "I can't see it in the old list, but the new one has 3 rows for it.", "The lookup failed with a timeout, so there is no price yet.",
        "I was unable to locate the parcel in the depot.", "I'm sorry for the delay. The order left on Friday.", "It cannot be sent before Tuesday because the stock is empty.", "You can't change it after it was sent.", "The courier refused the parcel, so it is back in the depot.",
        "I can't help with the price, but the order itself was sent on May 3 from Bremen.", "No results were found for that name.", "They declined the payment twice; the balance is still 12.", "I did not find a second order. The first one costs 18 euros.", "The policy of the shop does not cover damage in transit.",
        "I cannot confirm the date from this output.", "Sorry about that! Your order is number 55 and it will arrive tomorrow.", "Nothing was charged.", "We do not have that item in stock; the next delivery is on Thursday.",
    ],
    "de": [
        "Die Bestellung wurde am Montag verschickt und kostet 40 Euro.", "Ich konnte zu dieser Nummer keinen Eintrag finden.", "Die Abfrage ist fehlgeschlagen, deshalb liegt noch kein Preis vor.", "Es tut mir leid, dass es so lange gedauert hat. Das Paket ist jetzt in Bremen.", "Ich kann sie in der alten Liste nicht sehen, aber die neue enthält 3 Zeilen.",
        "Der Kunde hat die Annahme verweigert und das Paket liegt wieder im Lager.", "Die Rechnung ist noch nicht bezahlt.", "Vor Dienstag geht nichts mehr raus, das Lager ist leer.",
    ],
    "es": [
        "El pedido se envió el lunes y cuesta 40 euros.", "No encontré ningún registro con ese nombre.", "La consulta falló por tiempo y todavía no hay precio.", "No puedo ver el pedido en la lista antigua, pero la nueva tiene 3 filas.", "Siento la espera. El paquete está ya en Bremen.", "No hay más unidades en el almacén hasta el jueves.",
    ],
    "fr": [
        "La commande est partie lundi et elle coûte 40 euros.", "Je n'ai trouvé aucune ligne pour ce nom.", "La recherche a échoué, il n'y a donc pas encore de prix.", "Je ne peux pas voir la commande dans l'ancienne liste, mais la nouvelle en contient 3.", "Désolé pour l'attente. Le colis est à Bremen depuis hier.", "Il ne reste plus rien en stock avant jeudi.",
    ],
    "pt": [
        "A encomenda foi enviada na segunda e custa 40 euros.", "Não encontrei nenhum registo com esse nome.", "A consulta falhou e por isso ainda não há preço.", "Não consigo ver a encomenda na lista antiga, mas a nova tem 3 linhas.", "Desculpe a demora. O pacote já está em Bremen.", "Não há mais unidades no armazém até quinta.",
    ],
    "zh": ["订单已经在周一寄出，一共40欧元。", "没有找到这个名字的记录。", "查询失败了，所以暂时没有价格。", "抱歉让您久等，包裹已经到了不来梅。", "旧列表里我无法看到这笔订单，但新列表里有3条记录。", "周四之前没有库存。"],
}
WHOLE = [
    "Paris", "Yes", "Warehouse B", "42 km", "SELECT * FROM t", "https://example.org/a/b?c=d", "def f(x):\n    return x + 1", "Bremen, Hamburg, Kiel", "3.5", "ops@example.org", "/var/log/app/run.log", "2031-04-05", "order_total", "Nein", "Sí", "Oui",
    "x = 3\nprint(x)", "SELECT a, b FROM orders WHERE a = 3 LIMIT 5", "No", "Monday", "EUR 40.00", "config.yaml", "Anna Schmidt", "import os\nos.remove('x')", '{"a": [1, 2]}', "- apples\n- pears", "| a | b |\n|---|---|\n| 1 | 2 |", "```python\nx = 1\n```", "print('x')", "Kiel / Bremen",
]
CUT = [
    "The order was sent on Monday and it will", "The order was sent on Mon", "I found three rows for that name, the newest of them is", "Nothing was charged for it; the balance rem", "The refund was processed by the", "Yes, the order left Bremen and",
    '{"items": [{"a": 1},\n\n{"a": 2}', '{"items": [{"a": 1}, {"b": "tex', "Here is the code:\n\n```python\ndef f(x):\n    return x", "def f(x):\n    return (x +", "SELECT a, b FROM", "The list (sorted by date, newest first", "- The first was paid.\n- The second was ref", "- The refund for MG2369 was refu",
    "Die Bestellung wurde am Montag versch", "Die Rechnung ist bezahlt und das Paket liegt", "El pedido se envió el lunes y ahora est", "El precio es de 40 euros y el", "La commande est partie lundi et elle coû", "Le colis est arrivé à Bremen, mais la", "A encomenda foi enviada na segunda e cus", "O preço é de 40 euros e a",
    "订单已经在周一寄出，一共", "查询失败了，所以暂时没有", "The order was sent on Monday... [truncated]", "The order was sent to Bremen and the courier…", "<think>First I need to look at the", '<tool_call>\n{"name": "find_order", "arguments": {"id": "55', "<answer>The order was sent on Mon</answer>", "The price is **40 euros and the",
]
FOREIGN = [
    "L'ordine è stato spedito lunedì e il prezzo della merce non è ancora nella lista.", "Non ho trovato questo nome nella lista, perché il registro è vuoto.", "Il pacco è alla stazione di Brema e la consegna è prevista per giovedì.", "De bestelling is maandag verstuurd en het pakket wordt donderdag bezorgd.",
    "Het systeem heeft geen prijs voor deze bestelling, maar er is nog een oude lijst.", "Er zijn drie regels met deze naam, waar het nieuwste van vrijdag is.", "Заказ был отправлен в понедельник и стоит сорок евро.", "В списке нет такой записи, поэтому цены пока нет.", "Zamówienie zostało wysłane w poniedziałek i jest już w drodze do Bremy.",
    "Nie ma takiego wpisu, który dotyczy tego numeru, ale jest nowa lista.", "Beställningen är skickad och det kostar inte något extra för er.", "Sipariş pazartesi günü gönderildi ve bu fiyat daha sonra değil bir hafta için var.", "注文は月曜日に発送され、合計は四十ユーロです。", "주문은 월요일에 발송되었고 총 사십 유로입니다.", "Η παραγγελία στάλθηκε τη Δευτέρα και κοστίζει σαράντα ευρώ.",
    "Die Bestellung wurde am Montag verschickt und kostet nicht mehr als 40 Euro.", "El pedido se envió el lunes y no cuesta más que 40 euros.", "La commande est partie lundi et elle ne coûte pas plus de 40 euros.", "A encomenda foi enviada na segunda e não custa mais do que 40 euros.", "订单已经在周一寄出，一共四十欧元。", "تم إرسال الطلب يوم الاثنين ويكلف أربعين يورو.",
]
COPIES = [lambda p: p, str.upper, lambda p: "User: " + p, lambda p: p + "\n" + p, lambda p: '"' + p.rstrip("?？") + '"', lambda p: "<answer>" + p + "</answer>"]


def cases():
    for lang, found in REFUSALS.items():
        yield from ((ASK[lang], t, "refusal") for t in found)
    for lang, found in SOUND.items():
        yield from ((ASK[lang], t, None) for t in found)
    yield from ((ASK["en"], t, None) for t in WHOLE if t not in ("Nein", "Sí", "Oui"))
    yield from ((ASK[k], t, None) for k, t in (("de", "Nein"), ("es", "Sí"), ("fr", "Oui")))
    start = {"Die": "de", "El ": "es", "La ": "fr", "Le ": "fr", "A e": "pt", "O p": "pt", "订单已": "zh", "查询失": "zh"}
    yield from ((ASK[next((k for s, k in start.items() if t.startswith(s)), "en")], t, "truncated") for t in CUT)
    yield from ((ASK["en"], t, "wrong_language") for t in FOREIGN)
    yield from ((p, f(p), "copy") for p in ASK.values() for f in COPIES)
    yield from ((ASK["en"], t, "empty") for t in (None, "", " \n ", "...", "<answer> </answer>", "<think>It is done.</think>", "N/A", "none", "<tool_call></tool_call>", "-"))


def test_held_out_cases():
    every = list(cases())
    assert len(every) >= 200
    got = [(want, pairs.defect(answer, prompt, prompt, None), answer) for prompt, answer, want in every]
    wrong = [x for x in got if x[0] != x[1]]
    for kind in ("empty", "truncated", "refusal", "copy", "wrong_language"):
        hit = sum(w == g == kind for w, g, _ in got)
        assert hit >= 0.9 * sum(w == kind for w, _, _ in got), (kind, wrong)
        assert hit >= 0.9 * sum(g == kind for _, g, _ in got), (kind, wrong)
    assert sum(g is None for w, g, _ in got if w is None) >= 0.95 * sum(w is None for w, _, _ in got), wrong
    print(Counter((w, g) for w, g, _ in wrong), wrong)


@pytest.mark.parametrize(
    ("users", "answer"),
    [
        (ASK["en"] + " Please answer in Italian.", FOREIGN[0]), ("Translate this into Russian for me: the order was sent on Monday.", FOREIGN[6]), (ASK["de"] + " Antworte bitte auf Niederländisch.", FOREIGN[3]), (ASK["en"] + " Reply in Japanese.", FOREIGN[12]),
    ],
)
def test_languages_that_were_asked_for(users, answer):
    assert pairs.defect(answer, users, users, None) is None


def test_system_may_ask_for_a_language():
    assert pairs.defect(FOREIGN[0], ASK["en"], ASK["en"], "it") is None
    assert pairs.defect(FOREIGN[0], ASK["en"], ASK["en"], None) == "wrong_language"
