"""Labels for measuring: where the test tables' documents name persons, by the names that those tables are known to use, and other names to put in their place."""

import random

import regex

# The names of the test tables.
GIVEN = (
    "Ines Callum Gideon Wren Amos Silas Edmund Nia Beth Hollis Rowan Odette Ada Tess Priya Mira Jonah Marcus Tomás Raúl Marisol Nuria Joaquín Ximena Gonzalo Begoña Íñigo Ramiro Inés "
    "Andrés Pilar Leocadia Ulf Matthis Anke Tilo Jürgen Henning Heike Jana Lotte Ruprecht Käthe Wiebke Sören Dörte Rémi Thibault Loïc Zoé Élodie Hélène Aurélien Solène Noémie Gaspard "
    "Maëlle Bastien Capucine Yves"
).split()
FIRST = "Bren Corv Dunn Fen Gris Hask Ild Kel Lam Marr Nev Orm Osk Pell Quis Rov Strand Tal Thorn Ulv Vash Wex Yar Zell".split()
LAST = "aldi anza beck dale escu ette feldt gård ham herr ino ière mark mund oux ovic quist sen ström tel ués verin wick worth".split()
# Names from elsewhere that no list of the library has.
OTHER_GIVEN = "Agnieszka Bronisław Cheng Dragana Ebele Fumiko Giuseppe Hiroshi Ilse Jadwiga Kwame Ludmila Mehmet Ngozi Oksana Piotr Rajesh Svetlana Takumi Umar Wanjiru Xiulan Yusuf Zdeněk Aoife Burak Eilidh Fatoumata".split()
OTHER_FAMILY = "Kowalczyk Yamamoto Adeyemi Chaudhary Petrović Nakamura Wiśniewska Bianchi Ferrari Okonkwo Papadopoulos Horvat Novák Szabó Yılmaz Demir Nguyen Banerjee Kapoor Haraldsdóttir Lindqvist Kovalenko Mwangi Dlamini Achterberg Vandenberghe Raghunathan Zieliński".split()

_FAMILY = rf"(?:(?:{'|'.join(FIRST)})(?:{'|'.join(LAST)}))"
_PART = r"(?:(?:von der|von|van der|van den|van|de la|de los|de|del|della|di|da|du|le|la|zu|zur) )"
_WHOLE = rf"{_PART}?{_FAMILY}(?:-{_FAMILY})?(?: (?:y |e )?{_FAMILY})?"
_NAME = regex.compile(
    rf"(?i)(?<![\p{{L}}\d@+_])(?<![\p{{L}}\d][-.])(?:(?:{'|'.join(GIVEN)})(?:[ -](?:{'|'.join(GIVEN)}))?(?: \p{{L}}\.(?! \p{{L}}\.))* {_WHOLE}|(?:\p{{L}}\. ?){{1,3}}{_WHOLE}"
    rf"|{_FAMILY}(?:-{_FAMILY})?, ?(?:(?:{'|'.join(GIVEN)})|\p{{L}}\.))(?![\p{{L}}\d@])"
)
_TOKEN = regex.compile(rf"(?i)(?:{_FAMILY}|{'|'.join(GIVEN)})(?!\p{{L}})")


def _like(word: str, model: str) -> str:
    return word.upper() if model.isupper() else word.lower() if model.islower() else word


def with_other_names(text: str, seed: int) -> tuple[str, list[str]]:
    """The text with every name of the test tables replaced by one from elsewhere in the same form and case, and those names in order."""
    rnd, out, names, last = random.Random(seed), [], [], 0
    given = {g.lower() for g in GIVEN}
    for m in _NAME.finditer(text):
        new = _TOKEN.sub(lambda x: _like(rnd.choice(OTHER_GIVEN if x[0].lower() in given else OTHER_FAMILY), x[0]), m[0])
        out += [text[last : m.start()], new]
        names.append(new)
        last = m.end()
    return "".join([*out, text[last:]]), names
