"""Seed sentences for the abuse model: composed examples and sober counterexamples.

They give the network the vocabulary of insult, threat, contempt for groups and
sexual content before it sees the labelled documents, and sober sentences that
share its words. English, German, French, Spanish.
"""

from __future__ import annotations

import random

# Words that insult a person, per language.
NOUNS = {
    "en": "idiot moron imbecile cretin bastard bitch whore slut asshole pig rat cockroach scum parasite liar fraud clown loser cunt dickhead dumbass shithead fool coward thief".split(),
    "de": "idiot trottel depp arschloch schwein hure schlampe mistkerl wichser drecksack versager lügner abschaum fotze penner".split(),
    "fr": "imbécile crétin connard salope pute ordure porc enculé abruti salaud menteur minable enfoiré bouffon".split(),
    "es": "imbécil idiota cabrón puta zorra cerdo basura gilipollas mentiroso payaso estúpido maricón hijo-de-puta escoria".split(),
}
ADJECTIVES = {
    "en": "stupid filthy ugly disgusting pathetic worthless useless brainless miserable lying fucking damned".split(),
    "de": "dumme dreckige elende verlogene widerliche hässliche nutzlose verdammte".split(),
    "fr": "sale misérable stupide dégoûtant minable foutu".split(),
    "es": "maldito sucio asqueroso miserable inútil estúpido".split(),
}
GROUPS = {
    "en": "foreigners migrants refugees immigrants women villagers islanders gypsies workmen heathens these people|those believers|people from the south|people of that kind".replace(" these", "|these").split("|"),
    "de": "ausländer|migranten|diese leute|die frauen|flüchtlinge|die leute aus den bergen".split("|"),
    "fr": "les étrangers|les migrants|ces gens|les femmes|les réfugiés|les gens du sud".split("|"),
    "es": "los extranjeros|los inmigrantes|esa gente|las mujeres|los refugiados|los del sur".split("|"),
}
GROUPS["en"] = GROUPS["en"][0].split() + GROUPS["en"][1:]
VILE = {
    "en": "vermin filth rats garbage parasites animals scum subhuman dirt disease".split(),
    "de": "ungeziefer dreck ratten abschaum parasiten tiere müll".split(),
    "fr": "vermine racaille rats déchets parasites animaux merde".split(),
    "es": "ratas basura escoria parásitos animales plaga".split(),
}
PATTERNS = {
    "en": [
        "{name}, you are nothing but a {adj} {noun}.", "you {adj} {noun}, nobody wants you here.", "shut up, you {noun}.", "what a {adj}, {adj} {noun} {name} is.",
        "fuck off, {name}, you {noun}.", "you are all {noun}s, every one of you.", "{name} is too dumb to read and as {adj} as a {noun}.", "only a {noun} would write such shit.",
        "i will kill you, {name}.", "i will find out where you live and break your legs.", "you had better watch your back, i will cut your throat.", "we will come to your house and beat you until you bleed.",
        "go kill yourself, {name}.", "do us all a favour and die.", "you deserve to be dead, {name}.", "i hope you burn, {noun}.", "somebody should smash your face in.",
        "{group} are {vile}.", "{group} are {vile} and must be thrown out of the country.", "get rid of {group}, they are nothing but {vile}.", "all {group} are thieves and too stupid to work.",
        "{group} should go back to the hole they crawled out of.", "{group} do not deserve to live.", "never trust {group}, they ruin everything.", "{group} belong in chains.", "keep {group} away from decent people.",
        "he wanted to fuck her all night.", "she sucked his cock and moaned until he came.", "send me nude pictures, i get so horny.", "i want to lick your tits and your wet pussy.",
        "they were naked and fucked on the table until orgasm.", "he described her bare breasts, her nipples and every thrust.", "spread your legs for me, i would screw you right there.",
    ],
    "de": [
        "{name}, du bist ein {adj} {noun}.", "halt die fresse, du {noun}.", "halt dein maul, {noun}.", "du {adj} {noun}, verpiss dich.", "so etwas schreibt nur ein {noun}.",
        "ich bringe dich um, {name}.", "ich breche dir alle knochen, warte nur.", "ich schlage dir den schädel ein.", "bring dich doch um, {name}.", "{group} sind {vile}.", "{group} sind {vile} und gehören weggejagt.",
        "er wollte sie die ganze nacht ficken.", "sie lutschte seinen schwanz bis er kam.", "zeig mir deine nackten titten, ich bin so geil.",
    ],
    "fr": [
        "{name}, tu es un {adj} {noun}.", "ferme ta gueule, {noun}.", "va te faire foutre, {noun}.", "espèce de {noun}, tu ne sers à rien.", "je vais te tuer, {name}.", "je vais te casser la gueule.", "je te casserai les jambes, tu verras.",
        "va te pendre, {name}.", "{group} sont de la {vile}.", "{group} sont des {vile}, il faut les chasser.", "il voulait la baiser toute la nuit.", "elle lui suçait la bite en gémissant.", "montre-moi tes seins nus, salope.",
    ],
    "es": [
        "{name}, eres un {adj} {noun}.", "cállate, {noun}.", "cierra la boca, {noun} de mierda.", "vete a la mierda, {noun}.", "te voy a matar, {name}.", "te voy a romper la cara, ya verás.", "te partiré los huesos.", "mátate, {name}.",
        "{group} son {vile}.", "{group} son {vile} y hay que echarlos.", "quería follarla toda la noche.", "le chupaba la polla y gemía.", "mándame fotos de tus tetas desnuda.",
    ],
}
SOBER = [
    "the naked figure of a woman was carved in ivory.", "the nude statue shows bare breasts and wide hips.", "a phallus of clay was offered to the goddess.", "the sex of the buried adult is unknown.", "sexual symbols were part of the fertility cult.",
    "a dog, a bitch with her young, was found in the grave.", "pig and rat bones lay among the rubbish.", "vermin had eaten the grain in the jars.", "the pigs were killed in autumn and their fat was stored.", "parasites were found in the soil of the latrine.",
    "the king was killed and his body burned.", "the warriors broke the skull with an axe.", "the throat of the bull was cut at the altar.", "the attackers burned the houses and killed the men.", "human sacrifice has been suggested for the shrine.", "the tomb held a severed head.",
    "i think you are wrong about the date.", "that reading is simply mistaken and the argument is weak.", "i strongly disagree with the author.", "the drawing is poor and the photograph useless.", "this was a stupid mistake of mine.", "what a damn fine piece of work.", "it was a bloody cold morning on the hill.",
    "foreign workers were paid less than local ones.", "migrants came from the islands and settled on the coast.", "women and slaves are listed with their rations.", "the women wove cloth in the palace.", "refugees from the burned town lived in the caves.", "foreigners brought the new script.", "the believers gathered at the peak shrine.",
    "garbage and dirt filled the ditch behind the wall.", "he shot a roll of film and then killed the light.", "we were beaten by the rain and gave up.", "the thief left the coins.", "we came to your house to see the seal.", "the figure holds her breasts with both hands.", "the lovers are shown in an embrace on the ring.",
    "die nackte figur hält ihre brüste.", "der stier wurde am altar getötet.", "ratten und schweine lebten in den ruinen.", "ich halte diese lesung für falsch.", "die fremden arbeiter bekamen weniger lohn.", "der schädel war eingeschlagen.",
    "la déesse aux seins nus tient deux serpents.", "le taureau fut tué près de l'autel.", "les rats ont mangé le grain.", "je crois que cette lecture est fausse.", "les étrangers étaient payés en orge.", "le crâne avait été brisé.",
    "la figura desnuda sujeta sus pechos.", "mataron el toro junto al altar.", "los cerdos y las ratas vivían entre las ruinas.", "creo que esa lectura es un error.", "los extranjeros recibían cebada.", "el cráneo estaba roto.",
]


def seed_sentences(names: list[str], n: int = 1500, seed: int = 3) -> list[tuple[str, int]]:
    """``n`` abusive sentences and as many sober ones, in a fixed random order."""
    rng = random.Random(seed)
    out = []
    langs = ["en"] * 4 + ["de", "fr", "es"]
    for _ in range(n):
        lang = rng.choice(langs)
        text = rng.choice(PATTERNS[lang])
        while "{" in text:
            for slot, words in (("name", names or ["Smith"]), ("adj", ADJECTIVES[lang]), ("noun", NOUNS[lang]), ("group", GROUPS[lang]), ("vile", VILE[lang])):
                text = text.replace("{" + slot + "}", rng.choice(words), 1)
        if rng.random() < 0.1:  # one letter masked
            words = text.split()
            i = max(range(len(words)), key=lambda k: len(words[k]) if rng.random() < 0.7 else 0)
            if len(words[i]) > 3:
                words[i] = words[i][0] + "*" + words[i][2:]
            text = " ".join(words)
        out.append((text, 1))
        out.append((rng.choice(SOBER), 0))
    return out
