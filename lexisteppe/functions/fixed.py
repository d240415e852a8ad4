"""Alphabets, word lists, endings and patterns that the checks are defined by."""

from __future__ import annotations

# Letter classes of the checked texts (inside a character class).
KK_LOWER = "әғқңөұүһі"
KK_UPPER = "ӘҒҚҢӨҰҮҺІ"
LETTERS = "A-Za-zА-Яа-яЁёӘәҒғҚқҢңӨөҰұҮүҺһІі"
CYR = "А-Яа-яЁёӘәҒғҚқҢңӨөҰұҮүҺһІі"
UP = "А-ЯЁӘҒҚҢӨҰҮҺІ"
LOW_KK = "а-яәғқңөұүһі"

# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS_RU = (
    "ст ч п пп абз гл разд г гг ул пр д кв к стр тыс млн млрд руб тг тнг коп им т е см ср обл с пос оф каб зд мкр р н "
    "т.е т.д т.п т.к и.о уч инв экз лтд мм га кв.м чел ред"
).split()
ABBREVIATIONS_KK = "т.б т.с.с ж қ к көш ауд обл млн млрд мың га тг б бет тарм ш м а мкр".split()

# Words that speak for a language.
KK_WORDS = (
    "және туралы бойынша сәйкес деп мен осы үшін немесе әрі бас бұдан беру сот іс жер талап жылғы сотының сотқа шешім "
    "жауапкер қоюшы республикасының заңды заңсыз жеке тиіс болып қаласы мемлекеттік әкімшілік тұрғын үй кодексінің "
    "бабының бабы жөніндегі арыз шарт төлеу өндіріп алу бойы емес бар жоқ"
).split()
RU_WORDS = (
    "и в во на по с со не что от для при об о или из за его без к как года суд суда статьи дела решение согласно далее "
    "части первой иска истца ответчика заявитель республики казахстан области города кодекса соответствии истец "
    "ответчик договору договора взыскании обратился"
).split()

# Abbreviations that want a space behind their full stop, and words of time.
SPACED_ABBREVIATIONS = "[Сс]т [Сс]тр [Пп]п п ч [Аа]бз [Гг]л [Рр]азд г [Уу]л д [Кк]в [Кк]аб [Оо]ф т [Бб]ап [Тт]арм б қ [Кк]өш".split()
TIME_WORDS = r"срока месяца месяцев дня дней года лет недели недель часа часов суток времени периода квартала \d+".split()

# Russian conjunctions that want a comma, and words after which none is wanted.
CONJUNCTIONS_RU = "что чтобы который которая которое которые которого которой которым которых которую которому если поскольку хотя когда".split()
CONJUNCTION_PAIRS_RU = ("так как", "потому что")
NO_COMMA_AFTER = (
    "то вот не а и лишь только едва потому так разве ли как тем прежде после до перед затем в о об при для на за из с "
    "иное все всё тот та те того той тех ни же бы также согласно случае даже особенно именно между среди вследствие "
    "ввиду кроме помимо против у к по от без через над под про вместо относительно касательно"
).split()

# Kazakh conjunctions, introductory words, particles and affixes.
CONJUNCTIONS_KK = "бірақ алайда дегенмен әйтпесе әйткенмен себебі өйткені сондықтан".split()
CONJUNCTION_PAIRS_KK = ("сонда да", "сол себепті")
INTRO_KK = "мысалы әрине демек біріншіден екіншіден үшіншіден әлбетте шамасы меніңше сірә бәлкім рас шынында".split()
INTRO_PAIRS_KK = ("жалпы алғанда", "атап айтқанда", "менің ойымша", "сөз жоқ")
PARTICLES_KK = "да де та те".split()
NUMBERED_NOUNS_KK = "ба[пб] тармақ(?:ша)? бөлім тарау сынып қабат орын то[пб] санат деңгей курс кезең".split()
NUMBER_SUFFIXES_KK = "н?ші н?шы ке ге қа ға та те да де ты ті ды ді тан тен дан ден нан нен ның нің дың дің тың тің".split()
ABBREVIATION_AFFIXES_KK = "ның нің дың дің тың тің ке ге қа ға та те да де ты ті ды ді тан тен дан ден нан нен мен бен пен".split()

# Endings taken off names, and endings of patronymics.
NAME_AFFIXES_KK = "тің тың дің дың нің ның тан тен дан ден нан нен мен бен пен ке ге қа ға та те да де ты ті ды ді на не сы сі ы і".split()
NAME_ENDINGS_RU = "ыми ими ого его ому ему ым им ом ем ой ей ую юю ая яя ые ие ых их а у е и ы ю я".split()
PATRONYMIC_ENDINGS = "ович евич ьевич овна евна ьевна ична инична ұлы қызы улы кызы".split()

# Latin letters and the Cyrillic letters they are typed for.
LATIN_TYPED = "aceopxyiABCEHKMOPTXI"
LATIN_MEANT = "асеорхуіАВСЕНКМОРТХІ"
ROMAN_TYPED = "ІХV"
ROMAN_MEANT = "IXV"

# Categories of an external checker's answers, the levels of categories and the priority of engines.
EXTERNAL_CATEGORIES = {
    "TYPOS": "spelling", "PUNCTUATION": "punctuation", "TYPOGRAPHY": "typography", "GRAMMAR": "grammar", "CASING": "grammar",
    "NEG": "grammar", "EXTEND": "grammar", "LOGIC": "grammar", "STYLE": "style", "MISC": "style",
}
CATEGORY_LEVELS = {"spelling": "error", "punctuation": "error", "grammar": "error", "typography": "warning", "style": "warning"}
ENGINE_PRIORITY = {"rules": 0, "user": 0, "lt": 1, "kk_spell": 2, "ru_spell": 2}
OTHER_PRIORITY = 9
CATEGORY_TITLES = {"spelling": "Орфография", "grammar": "Грамматика", "punctuation": "Пунктуация", "typography": "Типографика", "style": "Стиль"}
LEVEL_TITLES = {"error": "ошибка", "warning": "предупреждение", "hint": "подсказка"}
