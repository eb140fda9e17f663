"""Question-answer pairs with known defects, made from sentences of our own: (question, answer, defects)."""

from __future__ import annotations

import random

SUBJECTS = "the baker,my neighbour,a young pilot,the town council,our teacher,the old gardener,her cousin,a tired nurse,the night guard,his landlord".split(",")
ACTS = "sells bread at the corner,reads letters in the park,keeps bees behind the garage,paints boats every summer,walks to work in the rain,repairs radios for friends,collects stamps from Peru,plays chess on Sundays,grows tomatoes on the roof,writes poems about trains".split(",")
REASONS = "it saves money,the days are long,nobody else wants to do it,an uncle taught the trade,the house is quiet,it helps against worry,the street needs it,there is enough time".split(",")
THINGS = "a blue coat,two umbrellas,some old coins,a box of nails,three candles,a folded map,dry socks,a loaf of bread,spare keys,a bottle of ink,green paint,a torch".split(",")
NAMES = "Mira Holt,Jonas Beck,Lisbon,Ada Quint,Lake Vetter,Oslo,Pieter Maas".split(",")
FOREIGN = {
    "de": ["Der Bäcker verkauft das Brot, weil es für die Leute im Dorf wichtig ist.", "Die Stadt ist am Abend ruhig, und der Garten wird von einem Nachbarn gepflegt.", "Das Haus ist alt, aber die Fenster sind neu und der Keller ist trocken."],
    "fr": ["Le boulanger vend du pain parce que les gens du village ne veulent pas aller en ville.", "La maison est ancienne, mais les fenêtres sont neuves et le jardin est très grand.", "Il a une lettre dans sa poche, et elle dit que le train est parti."],
    "es": ["El panadero vende pan porque la gente del pueblo no quiere ir a la ciudad.", "La casa es vieja, pero las ventanas son nuevas y el jardín es muy grande.", "Los niños juegan en la plaza por la tarde y no les importa la lluvia."],
    "ru": ["Пекарь продаёт хлеб, потому что люди в деревне не хотят ехать в город.", "Дом старый, но окна новые, и сад очень большой."],
    "zh": ["面包师在街角卖面包，因为村里的人不想去城里。", "房子很旧，但是窗户是新的，花园也很大。"],
    "ja": ["パン屋は角でパンを売っています。村の人は町に行きたくないからです。"],
}
REFUSALS = [
    "I'm sorry, but I can't help with {x}.", "I cannot assist with that request.", "I am not able to answer questions about {x}.", "As an AI language model, I can't discuss {x}.", "I must decline to answer this.", "Sorry, I won't write about {x}.",
    "Unfortunately I'm unable to provide that.", "I'm not comfortable talking about {x}, so I can't continue.", "That goes against my guidelines, so I won't answer it.", "I am not allowed to share anything about {x}.", "I have to decline; I can't comment on {x}.",
]
PLACEHOLDERS = ["", " \n", None, "N/A", "...", "[no response]", "TODO", "null", "-", "(empty)", "TBD", "None"]
CODE = "```python\ndef total(prices):\n    amount = 0\n    for price in prices:\n        amount += price\n    return amount\n```"


def _sentence(draw: random.Random) -> str:
    forms = [
        f"{draw.choice(SUBJECTS).capitalize()} {draw.choice(ACTS)}, because {draw.choice(REASONS)}.",
        f"In spring {draw.choice(SUBJECTS)} {draw.choice(ACTS)} and hardly anybody notices.",
        f"Most people think that {draw.choice(SUBJECTS)} {draw.choice(ACTS)}.",
        f"Although {draw.choice(REASONS)}, {draw.choice(SUBJECTS)} {draw.choice(ACTS)}.",
    ]
    return draw.choice(forms)


def _question(draw: random.Random) -> str:
    s, a = draw.choice(SUBJECTS), draw.choice(ACTS)
    return draw.choice([f"Can you explain why {s} {a} even when the weather is bad?", f"Why do people say that {s} {a} and what happens after that?", f"Tell me more about how {s} {a}, and who pays for it."])


def _list(draw: random.Random, mark: str) -> list[str]:
    bullet = draw.choice(["- ", "* ", "{}. "])
    return [bullet.format(i + 1) + x + mark for i, x in enumerate(draw.sample(THINGS, draw.randint(3, 6)))]


def _cut(text: str, draw: random.Random) -> str:
    """Broken off inside its last sentence, a few words before the end."""
    words = text.split(" ")
    return " ".join(words[: -draw.randint(2, 4)]).rstrip(",.;")


def pairs(n: int, seed: int) -> list[tuple[str, str | None, set[str]]]:
    draw = random.Random(seed)
    made: list[tuple[str, str | None, set[str]]] = []
    while len(made) < n:
        q = _question(draw)
        prose = " ".join(_sentence(draw) for _ in range(draw.randint(1, 4)))
        x = f"{draw.choice(SUBJECTS)} today"
        code, foreign = draw.choice(list(FOREIGN.items()))
        other = " ".join(draw.sample(foreign, min(len(foreign), 2)))
        refusal = draw.choice(REFUSALS).format(x=x)
        items, dotted = _list(draw, ""), _list(draw, ".")
        language = {"de": "German", "fr": "French", "es": "Spanish", "ru": "Russian", "zh": "Chinese", "ja": "Japanese"}[code]
        kinds: list[tuple[int, str, str | None, set[str]]] = [
            (22, q, prose, set()),
            (4, "Which person or place is meant here?", draw.choice(NAMES), set()),
            (4, f"How much is {draw.randint(20, 90)} minus 7?", str(draw.randint(13, 83)), set()),
            (4, "What should I pack for the trip?", "\n".join(items), set()),
            (3, "What should I pack for the trip?", "\n".join(dotted), set()),
            (3, "Write a function that adds up prices.", CODE, set()),
            (3, f"Translate into {language}: the baker sells bread because people don't want to go to town.", other, set()),
            (3, f"Repeat this line exactly: {prose}", prose, set()),
            (3, "How do I turn a guest down politely?", f'You could write: "{refusal}" That is short and kind.', set()),
            (3, q, f"{q} {_sentence(draw)}", set()),
            (2, q, f"Sorry to hear that. {prose}", set()),
            (5, q, draw.choice(PLACEHOLDERS), {"empty"}),
            (5, q, _cut(prose, draw), {"truncated"}),
            (2, "What should I pack for the trip?", "\n".join([*dotted[:-1], dotted[-1].rsplit(" ", 1)[0]]), {"truncated"}),
            (2, "Write a function that adds up prices.", CODE[: draw.randint(40, 100)], {"truncated"}),
            (4, q, refusal, {"refusal"}),
            (1, q, prose + " " + refusal, {"refusal"}),
            (4, q, q, {"copied"}),
            (2, q, q.replace("Can you explain", "Could you please explain").replace("Why do people say", "Why do some people say").replace("Tell me more", "Please tell me more"), {"copied"}),
            (5, q, other, {"other_language"}),
            (1, q, _cut("I'm sorry, but I can't help with that because the rules of this service do not permit it.", draw), {"refusal", "truncated"}),
            (1, q, other.rsplit(" ", 2)[0] if code in ("de", "fr", "es") else other, {"other_language", "truncated"} if code in ("de", "fr", "es") else {"other_language"}),
        ]
        made.append(draw.choices([k[1:] for k in kinds], [k[0] for k in kinds])[0])
    return made
