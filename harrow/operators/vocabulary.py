"""The words by which Japanese shop notices name goods, shops, places, dates and steps of a sale.

All of them are defaults of parameters; what is done with them is in notices, sections, reader,
catalog_pages and places. Patterns are regular expressions of the JVM.
"""

# ---- fixed values: the game and its goods
CARD = r"(?i)ポケモンカード|ポケカ|MEGA|拡張パック|ハイクラスパック|スタートデッキ|スペシャルセット|プレミアムデッキ"
GAME = r"(?i)ポケモンカード|ポケカ"
GOODS = r"(?i)拡張パック|強化拡張パック|ハイクラスパック|スタートデッキ|スターターセット|スペシャルセット|BOX|ボックス|MEGA"
KINDS = (
    "強化拡張パック", "ハイクラスパック", "拡張パックデラックス", "拡張パック", "スターターセットMEGA", "スターターセットex", "スターターセット", "スタートデッキ100 バトルコレクション", "スタートデッキGenerations", "スタートデッキ100", "スタートデッキ",
    "スターターデッキ＆ビルドセット", "バトルマスターデッキ", "デッキビルドBOX", "コレクションファイルセット", "スペシャルジャンボカードセット", "スペシャルカードセット", "プレミアムデッキセット", "カードイラストフィギュアコレクション", "バトルアカデミー",
    "30th CELEBRATION FUTURISTIC BOX", "30th CELEBRATION カードセット",
)
NO_CARDS = "デッキシールド|デッキケース|ラバープレイマット|プレイマット|カードスリーブ|カードボックス|ストレージボックス|コイン|ダメカン|マーカー|フリップデッキケース|キャリングケース|フレーム|ポスター|ぬいぐるみ"

# ---- fixed values: steps of a sale
SALE = "抽選"
ACTION = "応募|抽選へ進む|抽選販売専用サイト|抽選販売サイト|応募ページ|申込受付|エントリー|申し込"
RESALE = "再販売|再販|キャンセル分|追加販売"
STOP_LABELS = ("応募期間", "抽選期間", "受付期間", "当選発表", "結果発表", "購入期間", "購入期限", "受取期間", "受取期限", "引取期間", "引取期限", "販売期間", "注意事項", "応募条件", "応募専用")
STOP = r"^[\s【\[［(（]*(?:" + "|".join(STOP_LABELS) + ")"

# ---- fixed values: labels of date sections, and what ends one
APPLY_LABELS = (
    "抽選応募受付期間", "抽選申込受付期間", "抽選申込期間", "抽選応募期間", "抽選受付期間", "抽選販売受付期間", "応募受付期間", "申込受付期間", "お申し込み期間", "エントリー受付期間", "応募申込期間", "応募期間", "申込期間", "受付期間",
    "申込受付日時", "受付日時", "応募受付", "応募締め切り", "応募締切日時", "応募締切日", "応募締切", "申込締切日時", "申込締切日", "申込締切",
)
RESULT_LABELS = (
    "抽選結果発表予定日", "結果発表予定日", "抽選結果発表日時", "抽選結果発表日", "抽選結果発表", "当選者発表", "当選発表日時", "当選発表日", "当選発表", "結果発表", "抽選結果", "当落発表", "当落結果", "当選通知予定", "当選通知日", "当選通知",
    "当選者への連絡", "当選連絡", "抽選発表",
)
PURCHASE_LABELS = (
    "当選商品購入期間", "当選品購入期間", "店頭購入期間", "ご購入期間", "商品購入期間", "購入可能期間", "購入受付期間", "購入・受取期間", "購入期間", "購入期限日時", "購入期限日", "購入期限", "受取可能期間", "受け取り可能期間", "受取期間", "受け取り期間",
    "引取期間", "引き取り期間", "受取期限日時", "受取期限", "引取期限日時", "引取期限", "支払期限", "決済期限", "購入制限",
)
OTHER_LABELS = ("注意事項", "お問い合わせ", "チケット販売情報", "入場方法", "料金", "料 金", "購入枚数")
HARD_STOPS = r"(?i)^(?:受付終了|販売終了|予定販売数終了|チケット分配不可|入場方法|お問い合わせ|CONTACT|料\s*金|購入枚数|会員登録が必要)"
DRAW_HEADINGS, QUEUE_HEADINGS = "抽選販売受付|抽選受付|抽選申込", "先着販売受付"
#: Keys of dates in embedded data and in tables of facts.
DATE_KEYS = {
    "applyStart": ("applicationStartAt", "applicationStartDate", "entryStartAt", "entryStartDate", "receptionStartAt", "receptionStartDate", "application_start_at", "application_start_date", "entry_start_at", "entry_start_date", "reception_start_at", "応募開始日時", "応募開始日", "受付開始日時", "受付開始日", "申込開始日時", "申込開始日"),
    "applyEnd": ("applicationEndAt", "applicationEndDate", "entryEndAt", "entryEndDate", "receptionEndAt", "receptionEndDate", "deadlineAt", "application_end_at", "application_end_date", "entry_end_at", "entry_end_date", "reception_end_at", "deadline_at", "応募終了日時", "応募終了日", "応募締切日時", "応募締切日", "受付終了日時", "受付終了日", "申込終了日時", "申込終了日"),
    "result": ("lotteryResultAt", "lotteryResultDate", "resultAnnouncementAt", "winnerAnnouncementAt", "announceAt", "announcementAt", "lottery_result_at", "result_announcement_at", "winner_announcement_at", "announce_at", "announcement_at", "抽選結果発表日時", "抽選結果発表日", "当選発表日時", "当選発表日", "結果発表日時", "結果発表日"),
    "purchaseStart": ("purchaseStartAt", "purchaseStartDate", "pickupStartAt", "pickupStartDate", "redemptionStartAt", "redemptionStartDate", "purchase_start_at", "purchase_start_date", "pickup_start_at", "pickup_start_date", "redemption_start_at", "購入開始日時", "購入開始日", "受取開始日時", "受取開始日", "引取開始日時", "引取開始日"),
    "purchaseEnd": ("purchaseEndAt", "purchaseEndDate", "pickupEndAt", "pickupEndDate", "redemptionEndAt", "redemptionEndDate", "paymentDeadlineAt", "purchase_end_at", "purchase_end_date", "pickup_end_at", "pickup_end_date", "redemption_end_at", "payment_deadline_at", "購入終了日時", "購入終了日", "購入期限日時", "購入期限日", "受取終了日時", "受取終了日", "受取期限日時", "受取期限日"),
}

# ---- fixed values: shops and places
SHOPS = (
    r"フタバ図書\s*TSUTAYA[^\n（）()]{1,45}店", r"フタバ図書[^\n（）()]{1,45}店", r"ホビーステーション[^\n（）()]{0,35}店", r"(?:ふるいち|古本市場)[^\n（）()]{0,40}店", r"TSUTAYA[^\n（）()]{1,45}店",
    r"GIRAFULL(?:\([^)]*\))?[^\n（）()]{0,35}店", r"カードボックス[^\n（）()]{0,35}店", r"フルコンプ[^\n（）()]{0,35}店", r"カードラボ[^\n（）()]{0,35}店", r"トレカ[^\n（）()]{0,35}店",
)
CHAINS = r"(?i)古本市場|ふるいち|フタバ図書|TSUTAYA|蔦屋書店|BOOKOFF|ブックオフ|カードラボ|ホビーステーション|ホビステ|レプトン|駿河屋|ゲオ|GEO|イオン|ヤマダデンキ|ジョーシン|エディオン|ビックカメラ|トイザらス|カードボックス|晴れる屋2|ドラゴンスター|ポケモンセンター"
SELLERS = "販売元|主催者|主催|開催店舗|販売店舗|受取店舗|対象店舗"
PREFECTURES = (
    "北海道", "青森県", "岩手県", "宮城県", "秋田県", "山形県", "福島県", "茨城県", "栃木県", "群馬県", "埼玉県", "千葉県", "東京都", "神奈川県", "新潟県", "富山県", "石川県", "福井県", "山梨県", "長野県", "岐阜県", "静岡県", "愛知県", "三重県",
    "滋賀県", "京都府", "大阪府", "兵庫県", "奈良県", "和歌山県", "鳥取県", "島根県", "岡山県", "広島県", "山口県", "徳島県", "香川県", "愛媛県", "高知県", "福岡県", "佐賀県", "長崎県", "熊本県", "大分県", "宮崎県", "鹿児島県", "沖縄県",
)
#: Towns and stations that shops' names have, by prefecture, in the order in which they are looked for.
TOWNS = {
    "北海道": ("札幌", "函館", "旭川"),
    "青森県": ("青森", "弘前", "八戸"),
    "岩手県": ("盛岡",),
    "宮城県": ("仙台",),
    "秋田県": ("秋田",),
    "山形県": ("山形",),
    "福島県": ("福島", "郡山"),
    "茨城県": ("水戸", "つくば"),
    "栃木県": ("宇都宮",),
    "群馬県": ("高崎", "前橋"),
    "埼玉県": ("大宮", "所沢", "川越", "浦和"),
    "千葉県": ("千葉", "船橋", "柏", "津田沼"),
    "東京都": ("渋谷", "新宿", "池袋", "秋葉原", "日本橋店", "町田", "立川", "八王子", "吉祥寺"),
    "神奈川県": ("横浜", "川崎", "藤沢", "相模原"),
    "新潟県": ("新潟", "長岡"),
    "富山県": ("富山",),
    "石川県": ("金沢",),
    "福井県": ("福井",),
    "山梨県": ("甲府",),
    "長野県": ("長野", "松本"),
    "岐阜県": ("岐阜",),
    "静岡県": ("静岡", "浜松", "沼津"),
    "愛知県": ("名古屋", "豊橋", "岡崎", "一宮"),
    "三重県": ("四日市", "津駅"),
    "滋賀県": ("大津", "草津"),
    "京都府": ("京都",),
    "大阪府": ("梅田", "難波", "なんば", "天王寺", "心斎橋", "堺"),
    "兵庫県": ("神戸", "三宮", "姫路", "西宮"),
    "奈良県": ("奈良",),
    "和歌山県": ("和歌山",),
    "鳥取県": ("鳥取", "米子"),
    "島根県": ("松江", "出雲"),
    "岡山県": ("岡山", "倉敷"),
    "広島県": ("広島", "海田", "東広島", "西条中央", "可部", "三次", "福山", "呉市", "イオン広店", "サンモール店"),
    "山口県": ("下関", "山口"),
    "徳島県": ("徳島",),
    "香川県": ("高松",),
    "愛媛県": ("松山",),
    "高知県": ("高知",),
    "福岡県": ("博多", "天神", "北九州", "小倉", "久留米"),
    "佐賀県": ("佐賀",),
    "長崎県": ("長崎", "佐世保"),
    "熊本県": ("熊本",),
    "大分県": ("大分",),
    "宮崎県": ("宮崎",),
    "鹿児島県": ("鹿児島",),
    "沖縄県": ("那覇", "沖縄"),
}
PLACES = tuple((town, prefecture) for prefecture, towns in TOWNS.items() for town in towns)
PICKUP = "店頭受(?:取|け取り)|店舗受(?:取|け取り)|受取店舗|当選店舗|店頭購入|来店購入|来店受取|店頭引換|店頭販売|店舗で購入|レジで購入|受け取り店舗"
SHIPPING = "全国発送|発送|配送|郵送|宅配|送料|オンラインショップ|オンラインストア|通販|(?i:ECサイト)"
SHIPPING_TOO = r"発送も|配送も|発送対応|配送対応|店頭受取または配送|受取(?:方法)?[^。\n]*(?:発送|配送)"
BRANCH = r"(?:店|支店|本店|駅前|モール|センター|店舗)(?:\s|$|・|／|/)"
