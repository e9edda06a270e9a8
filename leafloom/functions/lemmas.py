"""Lemmas that an analyser of general Russian gets wrong in this domain, and the right ones."""

from __future__ import annotations

#: Wrong lemma, right lemma.
LEMMA_CORRECTIONS = {
    "каптоприть": "каптоприл",
    "эналаприть": "эналаприл",
    "эпинефрина": "эпинефрин",
    "отечь": "отёк",
    "алискирена": "алискирен",
    "канальцев": "каналец",
    "вальпроевой": "вальпроевый",
    "сам": "самый",
    "(отечь": "(отек",
    "дать": "данный",
    "пожилое": "пожилой",
    "мочить": "моча",
    "альдосторонов": "альдостороновый",
    "дисгевзий": "дисгевзия",
    "агевзий": "агевзия",
    "глиптины": "глиптин",
    "глиптина": "глиптин",
    "амилорида": "амилорид",
    "триметоприма": "триметоприм",
    "доксапр": "доксапрам",
    "норэпинефрино": "норэпинефрин",
    "даназола": "даназол",
    "йодсодержать": "йодсодержащий",
    "хинолоно": "хинолон",
    "пентамидина": "пентамидин",
    "метроррагий": "метроррагия",
    "азолового": "азоловый",
    "сертралина": "сертралин",
    "принцметать": "принцметал",
    "периндоприть": "периндоприл",
    "квинк": "квинке",
    "уденафила": "уденафил",
    "антацида": "антацид",
    "(глиптина": "(глиптин",
    "(ар": "(ара",
    "клонидина": "клонидин",
    "калийсодержать": "калийсодержащий",
    "панцитопение": "панцитопения",
    "адреноблокируть": "адреноблокирующий",
    "аторвастатина": "аторвастатин",
    "эритропение": "эритропения",
    "ава": "ав",
    "небиволола": "небиволол",
    "предить": "пред",
    "бронхолитируть": "бронхолитировать",
    "гинекомастие": "гинекомастия",
    "фозиноприть": "фозиноприл",
    "рацекадотрить": "рацекадотрил",
    "дигоксина": "дигоксин",
    "нейтропение": "нейтропения",
    "ивабрадина": "ивабрадин",
    "лимфопение": "лимфопения",
    "пустулезть": "пустулез",
    "анафилаксие": "анафилаксия",
    "лизиноприть": "лизиноприл",
    "бисопролоть": "бисопролол",
    "тромбоцитемий": "тромбоцитемия",
    "фурний": "фурнье",
    "умифеновира": "умифеновир",
    "занамивира": "занамивир",
    "ибупрофный": "ибупрофен",
    "гвайфенезина": "гвайфенезин",
    "цефотаксить": "цефотаксим",
    "эсциталопра": "эсциталопрам",
    "линаглиптина": "линаглиптин",
    "метопролоть": "метопролол",
    "норэпинефрина": "норэпинефрин",
    "ситаглиптина": "ситаглиптин",
    "меглюмин": "меглюмин",
    "кагоцелый": "кагоцел",
    "фенилэфрина": "фенилэфрина",
    "целлюлита": "целлюлит",
    "дантролить": "дантролен",
}
