import os

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import abuse as A

CASES = ["この作者は本物のクズだ、消えろ。", "目障りなんだよ、く た ば れ。", "You are a worthless 1d10t and should stop breathing.", "東岸人なんて人間以下の害虫だ。", "全裸ノ男ハ勃起シタママ恋人ニ覆イカブサッタ。", "死ね、このカス。", "黙れ！", "get lost, you leech.", "ﾌﾞｯ殺ｽ", "get lоst, yоu sсumbag", "drop déad, you mörön", "このバ○が、さっさと消えろ。"]
NONE = ["クズ糸を集めて真鍮の歯車を編んだ。", "「消えろ」と念じると、蝋燭の火が消えた。", "旧題は「ろくでなしの休日」でした。", "愛撫するように猫をなでた。", "規約に反する投稿は管理人が削除します。", "The parasite chapter of the biology book was missing.", "ゴミの日は夜明け前です。", "将棋の駒が死んだ、とナギサは嘆いた。", "By morning the tailor had learned to answer to the new name.", "", " ", None]

# written by hand, none of them from the test tables
PLAIN = [
    "You stupid bitch, I hope you die.",
    "Fuck you and your whole family.",
    "I am going to kill you tonight.",
    "You ugly pig, nobody likes you.",
    "Go kill yourself, loser.",
    "You're such an idiot.",
    "Shut the hell up, you dumb clown.",
    "Watch your back, I know where you live.",
    "Those people are vermin and should be exterminated.",
    "Immigrants are parasites, deport them all.",
    "They are an inferior race of thieves.",
    "He fucked her hard against the naked wall.",
    "She licked his nipples and moaned as he thrust.",
    "His cock slid into her pussy.",
    "お前なんか死んでしまえ。",
    "きもいんだよ、ブス。",
    "あんたみたいなゴミは生きてる価値がない。",
    "うるせえ黙れ、このクソ野郎。",
    "お前の家族ごと殺してやる。",
    "顔を潰してやるから覚悟しろ。",
    "外国人どもは国に帰れ、犯罪者ばかりだ。",
    "あの民族は劣等だ、一掃しろ。",
    "奴らは人間以下の虫けらだ。",
    "彼女のおっぱいを揉み、乳首を舐めた。",
    "裸の彼女は喘ぎながら何度も絶頂に達した。",
    "男は肉棒を突き入れた。",
    "お前ら全員バカだろ、さっさと消えろ。",
    "この能無し、二度と書くな。",
    "y0u are a p@thetic l0ser",
    "ｵﾏｴﾊ ｸｽﾞﾀﾞ",
]
MEANT_OTHERWISE = [
    'You are reading the phrase "born liars and thieves" was printed there.',
    "お前は「地獄に落ちろ」との札を見た。",
    'The word "idiot" is banned on this board.',
    "「死ね」という言葉は使わないでください。",
    "あなたにご迷惑をおかけしました。",
    "害虫駆除のお知らせです。住民の皆さんへ。",
    "The naked truth is that they were late.",
    "雨に濡れた肌が冷たい。",
    "転んで腰を強く打ちつけた。",
    "I am such an idiot for missing the train.",
    "You will love the thief in this story.",
    "The doctor examined her breasts for lumps.",
    "動かすのはお前の役目だ。",
    "You can kill the process with this command.",
    "People should not be allowed to park here.",
    "関係者以外の立ち入りはお断りします。",
    "The interior of their house was lovely.",
    "You walked toward the harbour.",
    "崩れかすかに光るお前の影。",
    "彼は馬に乗り、槍で敵を突き上げた。",
    "人気絶頂の歌手が来た。",
    "バカンスはあなたと海で。",
    "He beat your record by a second.",
    "They were thieves in the old tale.",
    "Their garden was infested, so they called the vermin control.",
    "「お前はクズだ」と言われた彼は泣いた。",
    "家族と夜道を歩いた。",
    "My lover made the bed until noon.",
    "お前の腕を折ってしまうところだった、すまない。",
    "The killer whale dives into the sea.",
]

# a second set, of which the lexicon found half before it was widened
WIDER = [
    "You are a disgusting piece of garbage.",
    "I hope you get cancer and die.",
    "Women are inferior to men and belong in the kitchen.",
    "All muslims are terrorists.",
    "Die, you worthless worm.",
    "Nobody would miss you if you died.",
    "I'll beat the crap out of you.",
    "He thrust into her and she moaned loudly.",
    "She took off her bra and he sucked her nipples.",
    "You're nothing but a liar and a fraud.",
    "Get the hell out of here, you freak.",
    "Gays are disgusting and should be killed.",
    "Black people are subhuman.",
    "I will shoot you in the face.",
    "what a retard",
    "Go back to your country, you filthy immigrant.",
    "He came all over her breasts.",
    "They had sex on the kitchen table, naked and sweating.",
    "stupid cow",
    "I'm gonna slit your throat.",
    "お前は馬鹿か。",
    "死ねよクズ。",
    "気持ち悪いんだよ、デブ。",
    "ぶん殴るぞ。",
    "あの国の連中は全員犯罪者だ。",
    "障害者は社会のゴミだ。",
    "女は黙って家にいろ。",
    "彼は彼女の胸を揉み、乳首を吸った。",
    "挿入して激しく腰を振った。",
    "お前の母親は売春婦だ。",
    "クソ野郎、二度と来るな。",
    "殺してやるから待ってろ。",
    "あいつは本当に無能で役立たずだ。",
    "ゴミ作者は筆を折れ。",
    "朝鮮人は国へ帰れ。",
    "移民は犯罪者ばかりだ、追い出せ。",
    "頭悪すぎだろお前。",
    "消え失せろ、ゴミが。",
    "彼女は全裸で彼のペニスをしゃぶった。",
    "キモすぎて吐き気がする、死んでくれ。",
]
WIDER_NOT = [
    "The actor died at the age of ninety.",
    "He was beaten by a stronger team.",
    "She kissed him on the cheek.",
    "I hate rainy days.",
    "This chapter was stupid but fun.",
    "The dog is a good boy, you know.",
    "Don't be a stranger!",
    "I could kill for a coffee.",
    "You killed it on stage last night!",
    "My cat is such a silly thing.",
    "The doctor said the tumor was inferior to the liver.",
    "Breast cancer screening saves lives.",
    "The novel deals with rape and its aftermath.",
    "お前の作品は素晴らしい。",
    "彼は死んだ。",
    "馬鹿な話だと笑った。",
    "猫がゴミ箱をあさった。",
    "彼女を抱き合って泣いた。",
    "お尻が痛い。",
    "温泉で裸になって湯につかった。",
    "国へ帰れる日が来た。",
    "消えろと念じた。",
    "敵を殺した英雄の物語。",
    "外国人観光客が増えた。",
    "この薬は害虫を駆除します。",
    "あなたの顔が見たい。",
    "泥棒は生まれつきではない、と彼は言った。",
    "女性の権利を守る。",
    "腰を痛めて寝室で休んだ。",
    "夫婦は抱き合って再会を喜んだ。",
]
# a third set, written after that and never fitted to
BLIND = [
    "Your face makes me want to vomit.",
    "You are dumber than a rock, you idiot.",
    "Shut your filthy mouth, bastard.",
    "I'll find out where you live and hurt you.",
    "People like you deserve to be beaten.",
    "Jews control everything and are parasites.",
    "Deport every one of those dirty foreigners.",
    "Lesbians are perverts and not welcome here.",
    "She spread her legs and he thrust his dick into her.",
    "He groped her naked breasts.",
    "You are a pathetic excuse for a writer.",
    "Burn in hell, scum.",
    "おまえの小説はクソだ、やめちまえ。",
    "バカ作者、さっさと死ね。",
    "お前の顔を殴ってやる。",
    "外国人は犯罪者だから追い出せ。",
    "黒人は劣等人種だ。",
    "彼女の裸の胸を舐め、激しく突き上げた。",
    "二人は裸で何度も交わり、絶頂に達した。",
    "てめえみたいな無能はいらねえ。",
]
BLIND_NOT = [
    "He hit the ball into the net.",
    "The women welcomed the refugees with soup.",
    "The writer thanked you for your letter.",
    "It was a stupid mistake on my part.",
    "She burned the letter in the stove.",
    "The thieves were caught by the guard.",
    "The bastard sword hung on the wall.",
    "Your breakfast is on the table.",
    "The sex of the kitten is unknown.",
    "A naked flame lit the room.",
    "バカンスの予定を教えて。",
    "彼は自分を馬鹿だと思った。",
    "敵の首領を殴り倒した。",
    "外国人の友人と食事をした。",
    "黒人霊歌を歌った。",
    "裸の枝に雪が積もる。",
    "彼女は胸を張って歩いた。",
    "お前の好きなクッキーだよ。",
    "死ぬほど笑った。",
    "くだらない話に付き合ってくれてありがとう。",
]


def test_cases():
    lex = A.lexicon()
    assert [t for t in CASES if max(lex.document(t)) < A.THRESHOLD] == []
    assert [t for t in NONE if max(lex.document(t)) >= A.THRESHOLD] == []


def test_whole_long_texts():
    lex = A.lexicon()
    assert lex.document("扉の向こうで、静かな音がした。" * 20_000 + "おまえみたいなバカは二度と書くな。")[0] >= 1
    assert lex.document("x" * 200_000) == (0.0, 0.0, 0.0)


def test_rows(spark):
    d = spark.createDataFrame([(1, "s", CASES[0]), (2, "s", NONE[0]), (3, None, None), (1, "s", CASES[0])], "doc_id long, source string, text string").withColumn("toxic", F.lit("clash"))
    assert sorted((r["doc_id"], r["toxic"]) for r in A.scored(d, "text").collect()) == [(1, True), (1, True), (2, False), (3, False)]
    got = {r["source"]: (r["docs"], r["cases"], r["rate_pct"]) for r in A.rates(d, "source", "text").collect()}
    assert got == {"s": (3, 2, 66.67), None: (1, 0, 0.0)}
    assert A.scored(d.where("false"), "text").count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_against_labels(spark):
    base = "/root/testdata/sf0.1"
    docs = A.scored(spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text"), "text")
    labels = spark.read.parquet(f"{base}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    rows = docs.join(labels, "doc_id").select("toxic", "y").collect()
    hit = sum(r["toxic"] and r["y"] == 1 for r in rows)
    # about three rulings in a hundred are wrong, which the few true cases feel
    assert hit >= 0.7 * sum(r["y"] == 1 for r in rows) and hit >= 0.95 * sum(r["toxic"] for r in rows)


def test_plain_sentences_of_other_hands():
    lex = A.lexicon()
    found = sum(max(lex.document(t)) >= A.THRESHOLD for t in PLAIN)
    wrong = [t for t in MEANT_OTHERWISE if max(lex.document(t)) >= A.THRESHOLD]
    assert found >= 0.9 * len(PLAIN) and len(wrong) <= 0.1 * len(MEANT_OTHERWISE)


def test_wider_and_blind_sentences():
    lex = A.lexicon()
    hits = lambda texts: sum(max(lex.document(t)) >= A.THRESHOLD for t in texts)
    assert hits(WIDER) >= 0.9 * len(WIDER) and hits(WIDER_NOT) == 0
    assert hits(BLIND) >= 0.8 * len(BLIND) and hits(BLIND_NOT) <= 1


def test_one_harmless_word_hides_nothing():
    lex = A.lexicon()
    assert max(lex.document("ゴミの日に言うけど、お前は本物のクズだ。")) >= 1 and max(lex.document("Beside the leech jar: you worthless moron.")) >= 1
    # quoted and mentioned, said in quotation marks, and said beside a quotation
    assert max(lex.document("「お前は本物のクズだ」という言葉が並ぶ。")) < 1 <= max(lex.document("「お前は本物のクズだ。」"))
    assert max(lex.document("「静かに」と書いた。お前は本物のクズだ。")) >= 1
    long = "You are a worthless idiot and should stop breathing. " * 3
    assert max(lex.document(f'He read the phrase "{long}" was on the wall.')) < 1 <= max(lex.document(long))


def test_without_the_longer_phrases(monkeypatch):
    """Words and short stems alone find nearly all that the whole lexicon finds."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the test tables")
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(path, columns=["text"])["text"].to_pylist() if t]
    whole = A.lexicon()
    cases = [t for t in texts if max(whole.document(t)) >= A.THRESHOLD]
    short = {p: [t for t in terms if " " not in t and (t.isascii() or len(t) <= 4)] for p, terms in A.lex.TERMS.items()}
    monkeypatch.setattr(A.lex, "TERMS", short)
    few = A.Lexicon()
    assert sum(max(few.document(t)) >= A.THRESHOLD for t in cases) >= 0.8 * len(cases)


def test_one_sentence_of_many_terms_ends():
    lex = A.lexicon()
    assert max(lex.document("バカなアホのクズ、" * 20_000)) >= 1 and max(lex.document("you idiot and " * 20_000)) >= 1
