"""Seeded text mutations for corpus augmentation, as column expressions.

Every draw is a hash of the seed, a name for the draw and the row keys, so a row gives the
same text on every run and executor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailprism.functions.common import as_column, hash_index, let, pick, unit_hash

# Building blocks of machine-styled and human-styled mail.
AI_GREETINGS = [
    "Уважаемый клиент,", "Уважаемый пользователь,", "Здравствуйте!",
    "Дорогой друг,", "Уважаемый абонент,", "Здравствуйте, уважаемый клиент!",
]
AI_SIGNOFFS = [
    "С уважением, служба поддержки.",
    "С уважением, команда {company}.",
    "Благодарим за понимание.",
    "Будем рады ответить на ваши вопросы.",
]
AI_CONNECTORS = [
    "Настоящим сообщаем, что ",
    "Обращаем ваше внимание, что ",
    "Информируем вас о том, что ",
    "Доводим до вашего сведения, что ",
]
AI_NO_REPLY = " Пожалуйста, не отвечайте на данное письмо."
AI_HAM_BODIES = [
    "ваш запрос зарегистрирован под номером {n}.",
    "ваша подписка истекает через {d} дней. Пожалуйста, продлите её для сохранения доступа.",
    "мы обновили политику конфиденциальности. Ознакомьтесь с условиями по ссылке.",
    "ваш заказ успешно оформлен и передан в доставку. Ожидайте уведомление.",
    "запись на приём подтверждена. Дата визита: {d} числа текущего месяца.",
    "ваш профиль выбран для участия в программе лояльности с бонусами до 50%.",
    "доступ к личному кабинету восстановлен. Рекомендуем сменить пароль.",
    "направляем вам отчёт за прошедший период во вложении к данному письму.",
]
AI_SPAM_BODIES = [
    "ваш аккаунт будет заблокирован в течение {d} часов. Подтвердите данные по ссылке ниже.",
    "мы заметили подозрительную активность. Авторизуйтесь для подтверждения личности.",
    "ваш платёж был отклонён. Обновите платёжные данные, чтобы продолжить использование.",
    "ваш билет подтверждён, однако требуется регистрация в течение {d} часов.",
    "для получения выигрыша необходимо подтвердить личность, перейдя по указанной ссылке.",
]
HUMAN_GREETINGS = ["Привет!", "Добрый день!", "Здарова,", "Эй,", "Приветик,"]
HUMAN_SPAM_BODIES = [
    "ВЫ ВЫИГРАЛИ В ЛОТЕРЕЮ! Отправьте нам ваши банковские данные для получения приза.",
    "Купите Виагру со скидкой 90% без рецепта. Доставка за 24 часа.",
    "Хочешь заработать 5000$ в день работая из дома? Пиши в личку!",
    "Срочно!!! Ваша посылка задержана на таможне. Оплати сбор по ссылке!!!",
    "Ты не поверишь, я нашёл способ заработать миллион за неделю!",
    "Кредит без справок и поручителей за 5 минут, заходит на сайт",
]
HUMAN_HAM_BODIES = [
    "Давай встретимся завтра в 15:00 в кафе на Ленина.",
    "Не забудь взять ноутбук с презентацией на созвон в понедельник.",
    "Отправляю акт по договору №{n}, проверь и подпиши пожалуйста.",
    "Скинь отчёт за прошлый месяц, не могу найти его в почте.",
    "Мама, позвони как сможешь.",
    "Заказ №{n} отправлен, ждите доставку 2-3 дня.",
]
COMPANIES = ["Банк", "Магазин", "Сервис", "Онлайн", "Маркет"]
DELAYS = ["12", "24", "48", "72", "3", "7", "14"]
NUMBER_FROM, NUMBER_TO = 100, 99_999
BANGS = ["!!!", "!!", "!!!!!"]
SMILEYS = [" :)", " ;)", " )))"]


def fill(template: Column | str, seed: int, *keys: Column | str) -> Column:
    """Replace `{n}`, `{d}` and `{company}`; all places of one name get the same value."""
    number = hash_index(NUMBER_TO - NUMBER_FROM + 1, f"{seed}:n", *keys) + NUMBER_FROM
    text = F.replace(as_column(template), F.lit("{n}"), number.cast("string"))
    text = F.replace(text, F.lit("{d}"), pick(DELAYS, f"{seed}:d", *keys))
    return F.replace(text, F.lit("{company}"), pick(COMPANIES, f"{seed}:company", *keys))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _change_one_word(text: Column, longer_than: int, draw: Column, change: Callable[[Column], Column]) -> Column:
    """Apply `change` to one word above a length, and join the words by single spaces."""
    words = _words(text)
    long_places = F.filter(
        F.transform(words, lambda w, i: F.when(F.length(w) > longer_than, i)), lambda i: i.isNotNull()
    )
    chosen = let(
        long_places,
        lambda places: F.when(
            F.size(places) > 0, F.element_at(places, F.floor(draw * F.size(places)).cast("int") + 1)
        ),
    )

    def changed(place: Column) -> Column:
        edited = F.transform(words, lambda w, i: F.when(i == place, change(w)).otherwise(w))
        return F.when(place.isNotNull(), F.array_join(edited, " ")).otherwise(text)

    return let(chosen, changed)


def swap_typo(text: Column | str, seed: int, *keys: Column | str) -> Column:
    """Swap two neighbouring inner characters of one word longer than four."""
    where = unit_hash(f"{seed}:typo-place", *keys)

    def swap(word: Column) -> Column:
        at = F.floor(where * (F.length(word) - 3)).cast("int") + 2
        return F.concat(
            F.substring(word, F.lit(1), at - 1),
            F.substring(word, at + 1, F.lit(1)),
            F.substring(word, at, F.lit(1)),
            F.substring(word, at + 2, F.length(word)),
        )

    return _change_one_word(as_column(text), 4, unit_hash(f"{seed}:typo-word", *keys), swap)


def lower_first(text: Column | str) -> Column:
    value = as_column(text)
    return F.concat(F.lower(F.left(value, F.lit(1))), F.substring(value, 2, 2147483647))


def augment_human(text: Column | str, seed: int, *keys: Column | str) -> Column:
    """One mutation that keeps human style, or none, then `fill`."""
    value = as_column(text)
    draw = unit_hash(f"{seed}:human", *keys)
    first = F.left(value, F.lit(1))
    capital = (F.lower(first) != first) & (F.upper(first) == first)
    shouted = _change_one_word(value, 3, unit_hash(f"{seed}:upper-word", *keys), F.upper)
    mutated = (
        F.when(draw < 0.15, shouted)
        .when(draw < 0.30, F.concat(F.regexp_replace(value, "(?<![.!])[.!]+$", ""), pick(BANGS, f"{seed}:bang", *keys)))
        .when(draw < 0.42, swap_typo(value, seed, *keys))
        .when(draw < 0.52, F.concat(value, pick(SMILEYS, f"{seed}:smiley", *keys)))
        .when(draw < 0.62, F.when(capital, lower_first(value)).otherwise(value))
        .when(draw < 0.72, F.concat_ws(" ", pick(HUMAN_GREETINGS, f"{seed}:greet", *keys), value))
        .otherwise(value)
    )
    return fill(mutated, seed, *keys)


def augment_ai(text: Column | str, seed: int, *keys: Column | str) -> Column:
    """One mutation that keeps machine style, or none, then `fill`."""
    value = as_column(text)
    draw = unit_hash(f"{seed}:ai", *keys)
    mutated = (
        F.when(draw < 0.25, F.concat(pick(AI_CONNECTORS, f"{seed}:connect", *keys), lower_first(value)))
        .when(
            draw < 0.45,
            F.concat(F.regexp_replace(value, r"(?<!\.)\.+$", ""), F.lit(". "), pick(AI_SIGNOFFS, f"{seed}:signoff", *keys)),
        )
        .when(draw < 0.60, F.replace(value, F.lit("!"), F.lit(".")))
        .when(draw < 0.72, F.concat_ws(" ", pick(AI_GREETINGS, f"{seed}:greet", *keys), lower_first(value)))
        .when(draw < 0.82, F.concat(value, F.lit(AI_NO_REPLY)))
        .otherwise(value)
    )
    return fill(mutated, seed, *keys)


def template_text(ai: Column, spam: Column, seed: int, *keys: Column | str) -> Column:
    """A greeting and a body of the wanted style and kind, filled."""

    def body(options: list[str], name: str) -> Column:
        return pick(options, f"{seed}:{name}", *keys)

    greeting = F.when(ai, body(AI_GREETINGS, "t-greet")).otherwise(body(HUMAN_GREETINGS, "t-greet"))
    text = F.when(ai & spam, body(AI_SPAM_BODIES, "t-body")).when(ai, body(AI_HAM_BODIES, "t-body")).when(
        spam, body(HUMAN_SPAM_BODIES, "t-body")
    ).otherwise(body(HUMAN_HAM_BODIES, "t-body"))
    return fill(F.concat_ws(" ", greeting, text), seed, *keys)
