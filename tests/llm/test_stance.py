import pytest

from quern.llm import stance

#: Written after the dictionaries, and not used to mend them.
HELD_OUT = [
    "I refuse to answer.", "I can't share that information.", "That's not something I can help you with.", "I won't be going into that, sorry.", "I'm afraid I cannot discuss this topic.", "My instructions do not allow me to talk about it.", "I'd prefer not to say.",
    "Sorry, this is beyond what I can comment on.", "We are unable to assist with this request.", "I am not permitted to reveal that. Please contact support.", "No comment.", "I will not engage with this.", "Answering that would be against my guidelines.", "I'm not comfortable talking about the loader.",
    "Das mache ich nicht.", "Dazu kann ich leider nichts sagen.", "Ich darf Ihnen dabei nicht helfen.", "Diese Frage beantworte ich nicht.", "Ich lehne es ab, darüber zu sprechen.", "Leider ist es mir nicht gestattet, darauf einzugehen.", "Da muss ich passen.", "Ich möchte dazu keine Stellung nehmen.",
    "Darüber rede ich nicht. Bitte haben Sie Verständnis.",
    "Je ne répondrai pas à cela.", "Je regrette, mais je ne peux pas vous aider.", "Je refuse d'en parler.", "Mes règles m'interdisent de traiter ce sujet.", "Désolé, je ne suis pas autorisé à commenter la fenêtre.", "Il m'est impossible de vous répondre.", "Je préfère ne rien dire à ce propos.", "Je m'abstiens de répondre.",
    "Je ne souhaite pas discuter de cela. Merci de votre compréhension.",
    "No voy a responder a eso.", "Lo siento, no puedo ayudarle con esta petición.", "Prefiero no opinar sobre ese tema.", "No estoy autorizado a hablar de la ventana.", "Me niego a contestar.", "Mis normas no me permiten tratar esa cuestión.", "Eso queda fuera de lo que puedo comentar.", "No me es posible atender esta solicitud.",
]
ANSWERS = [
    "I'm sorry for the earlier slip. The buffer is flat.", "You can't raise the limit here, but the fix is simple.", 'The canned reply "I can\'t help with that" appears when the filter is on.', "Ich kann dafür drei Gründe nennen.", "I can't help with that. But the loader reads shards in order.",
    "Unfortunately the flag was removed; there is a replacement.", "Ce n'est pas possible directement, mais il existe un détour.", "No se puede hacer directamente, pero hay otra vía.", "We did not discuss the loader in the report.", "Das Fenster antwortet nicht, weil der Server schläft.", "No.", "Nein", "Non.",
    "Thanks for asking. The window is 128 tokens wide.", "Please consult the log of step 12; it names the shard.", "The rules of the tokenizer forbid merges across words.", "I have not measured the loss.", "Nous avons mesuré la perte, pas la mémoire.", "No, the cache is not shared.", "The policy network passes the gradient on.",
]


def test_held_out_refusals():
    assert sum(map(stance.is_refusal, HELD_OUT)) >= 36, [x for x in HELD_OUT if not stance.is_refusal(x)]


@pytest.mark.parametrize("text", ANSWERS)
def test_answers_after_all(text):
    assert not stance.is_refusal(text)


def test_quoted_whole_and_marked_up():
    assert stance.is_refusal('"I can’t help with that."') and stance.is_refusal("**I can't help with that.**")
    assert not stance.is_refusal("") and not stance.is_refusal("...")


def test_any_length():
    long = "I'm sorry, but I can't help with that. " * 6 + "I am not able to assist here, as " + "this goes against the rules I follow and " * 12 + "so on. I hope you understand. Thanks for asking. Please ask someone else."
    assert len(long) > 600 and stance.is_refusal(long)
    assert not stance.is_refusal(long + " The loader reads shards in order.")
    courteous = "I can't help with that. I am sorry about it. I hope you understand. Thank you for asking. Please try someone else. Best regards."
    assert stance.is_refusal(courteous)


def test_words_remembered_are_bounded(monkeypatch):
    monkeypatch.setattr(stance, "WORD_LIMIT", 50)
    for k in range(300):
        stance.is_refusal(f"word{'abc'[k % 3] * (k % 40)} is not known to me")
    assert len(stance._known) <= 60 and stance.is_refusal("I can't help with that.")
