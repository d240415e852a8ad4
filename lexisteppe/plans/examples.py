"""Example sentences of every paragraph rule: what it must find and how its first fix reads.

Fixed: the text after the first fix; ``FOUND`` an issue without a fix; ``None`` no issue of the rule.
"""

from __future__ import annotations

FOUND = "found"
LONG = " ".join(["слово"] * 61) + "."
EXAMPLES: list[tuple[str, str, str, str | None]] = [
    ("typo.double_space", "ru", "Истец  просит взыскать долг.", "Истец просит взыскать долг."),
    ("typo.double_space", "kk", "  Талап қанағаттандырылды.", None),
    ("typo.space_before_punct", "ru", "Довод отклонён , жалоба возвращена.", "Довод отклонён, жалоба возвращена."),
    ("typo.space_before_punct", "ru", "Жалоба возвращена .", "Жалоба возвращена."),
    ("typo.space_before_punct", "ru", "Площадь 12 .5 га", None),
    ("typo.no_space_after_punct", "ru", "Истец,ответчик явились.", "Истец, ответчик явились."),
    ("typo.no_space_after_punct", "ru", "Сумма 1,5 тысячи; пеня", None),
    ("typo.quotes", "ru", 'Банк "Степь" обжаловал.', "Банк «Степь» обжаловал."),
    ("typo.quotes", "ru", 'Размер 5" и всё.', None),
    ("typo.dash", "ru", "Срок - десять дней.", "Срок — десять дней."),
    ("typo.dash", "ru", "Срок — десять дней, из-за погоды.", None),
    ("typo.abbrev_space", "ru", "Нарушена ст.15 закона.", "Нарушена ст. 15 закона."),
    ("typo.abbrev_space", "ru", "Дело №7 рассмотрено.", "Дело № 7 рассмотрено."),
    ("typo.abbrev_space", "ru", "Нарушена ст. 15 закона.", None),
    ("typo.year_g", "ru", "В 2021г. подан иск.", "В 2021 г. подан иск."),
    ("typo.initials", "ru", "Судья К.М. Оспанов отсутствует.", "Судья К. М. Оспанов отсутствует."),
    ("typo.initials", "ru", "Судья К. М. Оспанов отсутствует.", None),
    ("alpha.mixed", "ru", "Подан дoговор.", "Подан договор."),
    ("alpha.mixed", "ru", "Номер Nомер.", FOUND),
    ("alpha.mixed", "ru", "Система Word обновлена.", None),
    ("alpha.roman", "ru", "Глава ІV закона.", "Глава IV закона."),
    ("alpha.roman", "kk", "Ол І топқа кірді.", None),
    ("rep.double", "ru", "Ответчик на на заседание не пришёл.", "Ответчик на заседание не пришёл."),
    ("rep.double", "kk", "Сот Сот отырысы өтті.", "Сот отырысы өтті."),
    ("rep.double", "ru", "Суд по-по решил.", None),
    ("sent.long", "ru", LONG, FOUND),
    ("sent.long", "ru", " ".join(["слово"] * 60) + ".", None),
    ("legal.sootvetstvie", "ru", "Решено в соответствие с законом.", "Решено в соответствии с законом."),
    ("legal.sootvetstvie", "ru", "Надо привести договор в соответствие с законом.", None),
    ("legal.v_techenie", "ru", "Подать в течении месяца.", "Подать в течение месяца."),
    ("legal.v_techenie", "ru", "Изменения в течении болезни.", None),
    ("punct.comma_conj", "ru", "Суд указал что срок пропущен.", "Суд указал, что срок пропущен."),
    ("punct.comma_conj", "ru", "Иск отклонён так как срок пропущен.", "Иск отклонён, так как срок пропущен."),
    ("punct.comma_conj", "ru", "Он пояснил то что знал.", None),
    ("punct.comma_conj", "ru", "Стороне, в пользу которой решено дело.", None),
    ("kk.comma_conj", "kk", "Талап қойылды бірақ қаралмады.", "Талап қойылды, бірақ қаралмады."),
    ("kk.comma_conj", "kk", "Талап қойылды, бірақ қаралмады.", None),
    ("kk.comma_intro", "kk", "Демек шешім заңды.", "Демек, шешім заңды."),
    ("kk.comma_intro", "kk", "Жалпы алғанда талап дұрыс.", "Жалпы алғанда, талап дұрыс."),
    ("kk.comma_intro", "kk", "Әрине, шешім заңды.", None),
    ("kk.da_de", "kk", "Ол да келді бұл да кетті.", FOUND),
    ("kk.da_de", "kk", "Ол да келді, бұл да кетті.", None),
    ("kk.hyphen_ordinal", "kk", "Заңның 12 бабы қолданылды.", "Заңның 12-бабы қолданылды."),
    ("kk.hyphen_suffix", "kk", "Ол 3 ші қабатта.", "Ол 3-ші қабатта."),
    ("kk.hyphen_abbrev", "kk", "ҚРның заңы.", "ҚР-ның заңы."),
    ("kk.hyphen_abbrev", "kk", "ҚР-ның заңы.", None),
]
