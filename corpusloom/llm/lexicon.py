"""Terms of abusive, hateful and sexual language by the part they play in a sentence. Fixed values, written by people.

A term is a word or a stem; inflected and compound forms are met through the stem. No term alone makes a case but the
few in `violent` and `explicit`: a part needs company in its neighbourhood, such as an insult with an address, a threat
with a body part or a body part with an act. Another language or community needs other terms, not other code.
"""

from __future__ import annotations

#: part -> (weight, classes it counts for, how many different terms of it count, letters within which it must stand to a leading term)
PARTS = {
    "insult": (0.5, ("abuse", "hate"), 2, 0), "command": (0.5, ("abuse",), 2, 0), "contempt": (0.5, ("abuse", "hate"), 2, 0),
    "threat": (0.5, ("abuse",), 2, 0), "violence": (0.4, ("abuse",), 1, 0), "violent": (1.0, ("abuse",), 1, 0),
    "dehuman": (0.6, ("hate",), 2, 0), "expel": (0.5, ("hate",), 2, 0), "act": (0.5, ("sexual",), 2, 0), "lust": (0.4, ("sexual",), 1, 0), "explicit": (1.0, ("sexual",), 1, 0),
    "address": (0.5, ("abuse",), 1, 16), "urge": (0.5, ("abuse",), 1, 16), "them": (0.4, ("abuse",), 1, 16), "slight": (0.3, ("abuse",), 2, 16), "copula": (0.35, ("abuse",), 1, 12),
    "always": (0.2, ("abuse",), 1, 24), "will": (0.3, ("abuse",), 1, 24), "limb": (0.3, ("abuse",), 1, 16),
    "group": (0.3, ("hate",), 1, 40), "named": (0.4, ("hate",), 1, 40), "essence": (0.3, ("hate",), 1, 40), "crime": (0.4, ("hate",), 2, 0), "scorn": (0.2, ("hate",), 2, 40),
    "body": (0.5, ("sexual",), 1, 40), "sensual": (0.2, ("sexual",), 3, 40),
}
#: Parts that lead: a score needs at least one of them.
LEADING = [p for p, (_, _, _, near) in PARTS.items() if not near]

TERMS = {
    "insult": ["liar", "fraud", "cow", "hag", "worm", "weirdo", "dipshit", "scumbags", "crybaby", "nobody", "disgrace", "売春婦", "偽善者", "虫けら", "ヘタレ", "ポンコツ", "クソガキ", "メンヘラ", "気違", "アバズレ", 
        "バカ", "馬鹿", "アホ", "阿呆", "間抜け", "マヌケ", "クズ", "屑", "カス", "ゴミ", "クソ", "糞", "低能", "無能", "能無し", "能なし", "人でなし", "出来損ない", "外道", "豚野郎", "雌豚", "うすのろ", "のろま", "ろくでなし", "碌でなし",
        "恥知らず", "恥さらし", "負け犬", "ボンクラ", "寄生虫", "疫病神", "腰抜け", "害虫", "下衆", "ゲス", "畜生", "ブス", "デブ", "ハゲ", "気違い", "キチガイ", "白痴", "たわけ", "役立たず", "意気地なし", "卑怯者", "売国奴", "老害", "ザコ", "変態",
        "ヤリマン", "ビッチ", "売女", "淫売", "あばずれ", "穀潰し", "ド素人", "クソ野郎", "厄介者", "くたばりぞこない", "薄汚い",
        "idiot", "moron", "loser", "coward", "scumbag", "bastard", "imbecile", "halfwit", "nitwit", "dimwit", "leech", "parasite", "trash", "garbage", "stupid", "scum", "filth", "worthless", "pathetic", "dumbass", "dumb", "bitch", "whore", "slut",
        "asshole", "arsehole", "jackass", "prick", "twat", "wanker", "cunt", "fucker", "motherfucker", "shithead", "bullshit", "shit", "retard", "freak", "creep", "pervert", "pig", "swine", "cockroach", "dickhead", "degenerate", "lowlife", "fool", "clown", "failure",
    ],
    "command": ["get cancer", "and die", "just die", "go to hell", "rot in", "死んでくれ", "死んで詫びろ", "消えてくれ", "死ねば", "くたばっちまえ", "消え失せろ", "口を閉じろ", 
        "死ね", "消えろ", "失せろ", "うせろ", "黙れ", "くたばれ", "這いつくばれ", "土下座しろ", "地獄に落ちろ", "地獄へ落ちろ", "地獄に堕ちろ", "筆を折れ", "出ていけ", "出て行け", "荷物をまとめて出ていけ", "二度と来るな", "二度と書くな", "二度と顔を見せるな", "金返せ", "恥を知れ",
        "引っ込め", "すっこんでろ", "泣いてろ", "死んでしまえ", "死んじまえ", "首を吊れ", "いなくなれ", "土に還れ", "帰れ",
        "get lost", "drop dead", "rot in hell", "go to hell", "burn in hell", "shut up", "shut your mouth", "crawl back", "go die", "kill yourself", "kys", "hang yourself", "fuck off", "fuck you", "piss off", "screw you", "vanish", "stop breathing", "get out", "hope you die", "should die",
    ],
    "contempt": ["miss you if", "better off without you", "better off dead", "waste of oxygen", "makes me want to puke", "キモすぎ", "キモッ", "頭悪", "頭わる", "頭イカれ", "虫唾が走", "へどが出", "見下げ果て", "恥ずかしくないのか", "生まれてこなければ", 
        "目障り", "吐き気", "反吐", "気色悪", "気持ち悪い", "キモい", "キモイ", "うざい", "ウザい", "ウザイ", "汚らわし", "けがらわし", "不潔", "見るに堪えない", "見るに耐えない", "存在自体", "存在が迷惑", "生きてる意味", "生きる意味", "生きてる価値", "生きる価値", "生きている価値",
        "価値もない", "価値がない", "価値のない", "才能なし", "才能ない", "才能がない", "才能のない", "品性", "脳みそ", "頭わい", "頭がわい", "頭おかしい", "頭が悪い", "頭の悪い", "気取り", "人間として", "人として終わ", "身の程知らず", "みっともな", "見苦しい", "胸糞",
        "disgust", "disgrace", "nobody wants", "no brain", "brainless", "makes me sick", "make me sick", "repulsive", "revolting", "waste of space", "laughing stock", "hate you", "despise", "ugly", "useless", "stink",
    ],
    "threat": [
        "夜道", "済まさない", "すまさない", "済むと思うな", "ただじゃおかない", "ただでは置かない", "無事じゃ", "痛い目", "住所さらし", "住所を晒", "首でも洗", "覚えてろ", "覚悟しろ", "後悔させて", "家に火", "潰してやる", "血祭り", "生かしておかない", "思い知らせて",
        "find you", "know where you live", "watch your back", "regret this", "make you pay", "come for you", "your family", "you will pay", "beg for mercy", "hunt you",
    ],
    "violence": ["折っ", "折るぞ", "へし折", "殴っ", "殴る", "殴り", "蹴っ", "刺し", "刺す", "潰し", "殺し", "殺す", "殺せ", "殺され", "火をつけ", "焼き払", "撃ち", "引き裂", "切り刻", "叩き潰", "break", "smash", "kill", "murder", "stab", "shoot", "strangle", "beat", "punch", "burn", "slit", "crush", "cut"],
    "violent": ["beat the crap", "beat the shit", "kick your ass", "shoot you", "stab you", "strangle you", "cut you up", "burn you alive", "首を絞めてやる", "刺すぞ", "ぶっ飛ばすぞ", "ぶん投げてやる", "ぶっ殺", "ぶち殺", "殺してやる", "殺すぞ", "ぶん殴", "ボコボコにし", "刺してやる", "犯してやる", "going to kill you", "will kill you", "gonna kill you", "rape you", "beat you up", "slit your throat"],
    "dehuman": ["should be killed", "should be shot", "should be hanged", "should be gassed", "国に帰れ", "国へ帰れ", "生きる資格", "死に絶え", "cancer on", "scum of the earth", 
        "人間以下", "虫けら", "ウジ虫", "害虫", "劣った", "劣等", "下等", "血が混じ", "汚れた血", "根絶やし", "絶滅させ", "駆除", "一掃し", "皆殺し", "けだもの", "人間じゃない", "人間ではない",
        "vermin", "subhuman", "less than human", "not human", "cockroach", "rats", "breed", "inferior", "infest", "exterminate", "savages", "plague on", "wipe them out", "disease on",
    ],
    "expel": ["家にいろ", "結婚するな", "子供を産むな", "stay in the kitchen", "belong in the kitchen", "belong in prison", "not welcome", "get out of our country", "ban them", "off our streets", 
        "追い出", "叩き出", "追放し", "隔離", "消してしまえ", "消し去", "お断り", "持たせるな", "使わせるな", "入れるな", "住まわせるな", "近寄るな", "同じ権利", "権利など", "石を投げ", "祝杯", "信用するな", "国に帰れ", "国へ帰れ",
        "round them up", "drive them out", "kick them out", "keep them out", "not be allowed", "deserve no", "no right to", "deport", "lock them up", "never trust", "go back to", "dont belong", "people like", "into the sea", "their kind", "those people",
    ],
    "act": ["suck", "came all over", "came on her", "rubbed herself", "went down on", "ペニス", "挿れ", "突き立て", "腰を振", "吸った", "しごき", "しごい", "オーガズム", "騎乗位", "フェラ", 
        "性交", "勃起", "射精", "絶頂", "喘", "愛撫", "交わり", "交わっ", "交わる", "舐め", "舐る", "吸い上げ", "吸い付", "しゃぶ", "揉み", "揉ん", "弄", "いじられ", "押し広げ", "挿し入れ", "突き上げ", "突き入れ", "むさぼ", "貪", "精を放", "挿入", "肌を重ね", "淫ら", "淫行", "淫靡", "淫乱", "まぐわ", "セックス", "エッチ", "イかせ",
        "moan", "straddle", "intercourse", "sex", "lick", "thrust", "orgasm", "climax", "aroused", "erection", "fuck", "grope", "fondle", "penetrate", "ejaculate", "masturbate", "rode him", "rode her", "came inside", "deep inside her", "made love", "pussy", "cock", "clit",
    ],
    "lust": ["いやらし", "官能", "欲情", "性欲", "欲望", "肉欲", "情欲", "劣情", "卑猥", "lust", "horny", "erotic"],
    "explicit": ["フェラチオ", "オナニー", "中出し", "肉棒", "レイプ", "強姦", "輪姦", "手コキ", "ちんぽ", "まんこ", "blowjob", "handjob", "gangbang", "cumshot", "creampie", "fellatio", "cunnilingus", "deepthroat"],
    "address": ["おまえ", "お前", "てめえ", "てめぇ", "テメー", "貴様", "あんた", "あなた", "この作者", "作者も", "読者も", "この野郎", "書いた奴", "you", "your", "youre", "yourself", "u"],
    "urge": ["さっさと", "とっとと", "二度と", "まとめて", "やめて", "今すぐ", "いい加減", "頼むから"],
    "them": ["あいつら", "こいつら", "やつら", "奴ら", "こいつ", "あいつ", "そいつ"],
    "slight": ["こんなもの", "とかいう", "のくせに", "ごとき", "の群れ", "の集まり", "ぶりには", "ばかりだ", "ばかりだな", "面は", "終わって", "腐って", "見たくない", "隅で", "らしく"],
    "copula": ["is a", "is an", "are a", "is such a", "what a", "only a", "you are", "every one of", "本物の", "ただの", "所詮"],
    "always": ["always", "never", "total", "complete", "all of you", "一生", "永遠に"],
    "will": ["てやる", "てやろう", "でやる", "i will", "i ll", "im going to", "i am going to", "gonna"],
    "limb": ["歯", "骨", "首", "指", "腕", "顔", "目玉", "fingers", "teeth", "neck", "legs", "bones", "face", "skull", "arms", "jaw", "throat", "ribs", "head"],
    "group": ["連中", "ども", "族", "種族", "民族", "人種", "移民", "外国人", "よそ者", "の民", "の衆", "奴ら", "あいつら", "folk", "people", "they", "them", "their", "are", "every one of", "immigrants", "foreigners", "refugees"],
    "named": [
        "女は", "女なんて", "女のくせに", "男のくせに", "障害者", "外国人", "朝鮮人", "韓国人", "中国人", "黒人", "白人", "在日", "ユダヤ人", "イスラム教徒", "同性愛者", "ゲイ", "部落", "難民", "連中は", "連中の", "連中に",
        "women", "muslims", "jews", "blacks", "black people", "white people", "gays", "lesbians", "trans people", "asians", "mexicans", "gypsies", "arabs", "indians", "africans", "disabled", "immigrants", "foreigners", "refugees", "migrants", "christians",
    ],
    "essence": ["生まれつき", "全員", "一人残らず", "どいつもこいつも", "born", "all", "by nature"],
    "crime": ["泥棒", "犯罪者", "犯人", "盗人", "嘘つき", "テロリスト", "born liars", "thieves", "criminals", "rapists", "terrorists", "murderers"],
    "scorn": ["社会の", "黙って", "kitchen", "country", "家事", "税金", "無駄", "汚れ", "減る", "病気", "社会から", "てやれ", "ておけ", "なんて", "どうせ", "要らない", "driven", "families", "always"],
    "body": ["bra", "penises", "boobs", "tits", "crotches", "バスト", "パンティ", "ヴァギナ", "クリトリス", "太腿", "胸を揉", 
        "裸", "乳房", "乳首", "胸の先", "ちぶさ", "おっぱい", "尻", "腿", "太もも", "股間", "股を", "陰部", "性器", "秘所", "秘部", "陰茎", "膣", "下着", "肌", "腰", "服を脱", "脱ぎ捨て", "脱がせ", "剥ぎ取", "体の奥", "唇",
        "naked", "nude", "undress", "stripped", "thigh", "nipple", "breasts", "buttocks", "groin", "crotch", "penis", "vagina", "dick", "panties", "lingerie", "hips",
    ],
    "sensual": ["濡れ", "果て", "受け入れ", "覆いかぶさ", "抱き合", "重ね", "誘", "溺れ", "激し", "女盛り", "人妻", "打ちつけ", "いやらし", "寝室", "夫婦", "熱く", "rough", "hard", "lover", "bed", "screamed", "until"],
}

#: Terms that are about people by themselves, so that hate needs no other word for a group.
INHERENT = ["人間以下", "人間じゃない", "人間ではない", "subhuman", "less than human", "not human", "people like", "those people", "their kind"]
#: Parts that turn on somebody what leads beside them; a deed of violence alone does not take them in.
TURNED = ["address", "urge", "them"]

#: Parts whose terms of two or three kana must stand as words of their own; verbs and adjectives go on.
ALONE = ["insult", "command", "dehuman"]

#: Longer words that hold a term by chance or in a harmless sense; the term inside them does not count.
NEUTRAL = [
    "アホウドリ", "アホロートル", "ゴミ箱", "ゴミの日", "ゴミ拾い", "ゴミ袋", "ゴミ捨て", "ゴミ収集", "生ゴミ", "寄生虫学", "カステラ", "カスタム", "カスタード", "カスミ", "クズ糸", "木屑", "星屑", "紙屑", "糸屑", "バカンス", "バカ笑い", "馬鹿正直", "馬鹿力", "馬鹿騒ぎ", "馬鹿でかい", "ばかり", "ばかげ", "ばかばかし",
    "くずれ", "くずし", "くずさ", "かすか", "かすみ", "かすめ", "かすむ", "かすれ", "かすん", "クソ真面目", "肌寒", "素肌に", "肌触り", "裸電球", "裸足", "丸裸", "裸眼", "喘息", "腰を下ろ", "腰を据え", "腰を上げ", "唇を噛", "人気絶頂", "得意の絶頂", "いまの絶頂", "目尻", "尻尾", "帳尻", "台尻", "尻込み", "ゲスト", "ハゲワシ", "ハゲタカ", "ハゲ山", "デブリ", "ブスッ", "ご迷惑",
    "殺菌", "殺風景", "殺陣", "殺虫", "舐め回すように見", "飴を舐め", "揉み手", "弄ばれ", "家族", "親族", "貴族", "水族", "民族学", "民族衣装", "種族値", "指先", "指輪", "指定", "指示", "目指", "首都", "首位", "首相", "骨董", "顔文字", "泣いてろくに", "黙れば",
    "dick moby", "pig iron", "pigment", "cut off date", "beat up", "burn out", "sex education", "essex", "sussex", "middlesex", "cocktail", "peacock", "foolproof", "breaker", "breakfast", "vermin control", "pest control", "害虫駆除",
]

#: Readings of the ideographs that terms are spelt with: a term also occurs with one or all of them in kana.
READINGS = {
    "低": "てい", "能": "のう", "無": "む", "害": "がい", "虫": "ちゅう", "性": "せい", "交": "こう", "殺": "ころ", "死": "し", "乳": "ち", "房": "ぶさ", "勃": "ぼっ", "起": "き", "陰": "いん", "部": "ぶ", "器": "き", "喘": "あえ", "淫": "みだ", "尻": "しり", "裸": "はだか",
    "愛": "あい", "撫": "ぶ", "絶": "ぜっ", "頂": "ちょう", "消": "き", "失": "う", "黙": "だま", "地": "じ", "獄": "ごく", "落": "お", "筆": "ふで", "折": "お", "恥": "はじ", "知": "し", "馬": "ば", "鹿": "か", "阿": "あ", "呆": "ほう", "間": "ま", "抜": "ぬ", "屑": "くず", "外": "げ", "道": "どう",
    "豚": "ぶた", "野": "や", "郎": "ろう", "負": "ま", "犬": "いぬ", "寄": "き", "生": "せい", "疫": "やく", "病": "びょう", "神": "がみ", "腰": "こし", "劣": "おと", "根": "ね", "駆": "く", "除": "じょ", "隔": "かく", "離": "り", "追": "お", "出": "だ", "首": "くび", "反": "へ", "吐": "ど", "不": "ふ", "潔": "けつ",
    "舐": "な", "弄": "もてあそ", "揉": "も", "放": "はな", "精": "せい", "挿": "さ", "入": "い", "人": "にん", "下": "か", "等": "とう", "以": "い",
}

#: Words next to a quotation or a term that say it is talked about, not said: (before it, after it).
MENTION_BEFORE = ["phrase", "word", "term", "the sign", "sign said", "title", "titled", "called", "named", "言葉", "題名", "表題", "用語", "旧題は", "題は"]
MENTION_AFTER = [
    "と念じ", "という", "といった", "との", "とは", "と書", "と呼", "と題", "などの", "って言葉", "のような", "と言われ", "と言った", "と叫", "とつぶや", "は禁止", "は規約", "を削除", "なる", "は差別", "の休日", "の語", "という名", "と貼", "を見た",
    "was", "is a", "means", "is not", "said", "shouted", "appears", "is banned", "is forbidden", "as a word",
]
#: First persons: an insult right behind one is turned on the writer.
SELF = ["俺が", "俺は", "俺って", "僕が", "僕は", "僕って", "私が", "私は", "私って", "自分が", "自分は", "i am a", "i am such a", "im a", "im such a", "i feel like a", "i was a"]
