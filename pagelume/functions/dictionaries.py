"""Word lists, domains and paths that results depend on. Every rule takes them as parameters."""

# Flags in cells.
TRUE_WORDS = ("1", "true", "yes", "да")
MARKERS = ("да", "yes", "y", "true", "1", "?", "нужна проверка")

# Page terms.
CATALOG_TERMS = ("каталог", "товар", "продукц", "интернет-магазин", "магазин", "catalog", "shop", "product")
CART_TERMS = ("корзин", "в корзину", "моя корзина", "cart", "basket", "shopping-cart", "checkout")
CHECKOUT_TERMS = ("оформить заказ", "оформление заказа", "перейти к оплате", "checkout", "place order")
BUY_TERMS = ("купить", "заказать онлайн", "добавить в корзину", "buy now", "add to cart", "add-to-cart")
DELIVERY_TERMS = ("доставк", "самовывоз", "delivery", "shipping")
PAYMENT_TERMS = ("оплат", "visa", "mastercard", "mir", "payment")
CONSUMER_TERMS = ("в наличии", "акция", "скидк", "новинки", "заказ онлайн", "быстрый заказ", "доставка по")
MANUFACTURER_TERMS = ("производитель", "собственное производство", "наш бренд", "официальный сайт", "бренд", "factory", "manufacturer")
REQUEST_TERMS = ("оставить заявку", "отправить заявку", "получить консультацию", "оставьте контакты", "связаться с менеджером")
CALLBACK_TERMS = ("заказать звонок", "обратный звонок", "перезвоните мне", "мы вам перезвоним", "callback")
QUOTE_TERMS = ("запросить кп", "коммерческ", "запросить предложение", "получить прайс", "рассчитать стоимость")
B2B_TERMS = ("оптов", "для дилеров", "производство", "промышлен", "корпоративн", "b2b")
HACKED_TERMS = ("casino", "viagra", "porn", "sex", "slot", "betting", "казино", "порно")

# Marks in HTML and paths.
CATALOG_MARKS = ("/catalog", "/catalogue", "/shop", "/products", "/product/", "/catalog/")
CART_MARKS = ("/cart", "/basket", "cart", "basket", "shopping-cart", "checkout", "data-cart")
CHECKOUT_MARKS = ("/checkout", "/order", "/personal/order", "checkout", "place-order")
PRODUCT_MARKS = ("/product/", "/products/", "/catalog/")
STRUCTURED_MARKS = ("schema.org/product", '"@type":"product"', '"@type": "product"', 'itemtype="https://schema.org/product"', 'itemprop="price"')
PLATFORM_MARKS = ("woocommerce", "shopify", "insales", "opencart", "cs-cart", "bitrix", "bitrix:catalog", "tilda-cart", "ecwid", "retailrocket")
SHOP_PATHS = ("/catalog/", "/catalog", "/shop/", "/shop", "/products/", "/products", "/cart/", "/cart", "/basket/", "/basket", "/checkout/", "/checkout", "/delivery/", "/delivery", "/payment/", "/payment")
OFF_TOPIC_LINKS = ("blog", "news", "contacts", "about", "vacancy", "privacy", "policy")
FILE_EXTENSIONS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".rar", ".jpg", ".jpeg", ".png", ".webp", ".gif", ".svg")
CONTACT_FILE_EXTENSIONS = (".pdf", ".jpg", ".png", ".zip", ".rar", ".xlsx")
LOADING_TITLES = ("loading...", "загрузка...")

# Domains.
MARKETPLACE_A = ("wildberries.ru", "www.wildberries.ru", "wb.ru", "www.wb.ru")
MARKETPLACE_B = ("ozon.ru", "www.ozon.ru")
MARKETPLACES = ("wildberries.ru", "wb.ru", "ozon.ru", "market.yandex.ru", "megamarket.ru", "aliexpress.ru")
BLOCKED_DOMAINS = (
    "wildberries.ru", "wb.ru", "ozon.ru", "market.yandex.ru", "amazon.com", "wikipedia.org", "2gis.ru", "yandex.ru", "google.com",
    "avito.ru", "instagram.com", "vk.com", "t.me", "telegram.me", "facebook.com", "youtube.com", "reg.ru",
)
SOCIAL_DOMAINS = ("t.me", "telegram.me", "vk.com", "instagram.com", "youtube.com", "facebook.com")
DIRECTORY_WORDS = ("rusprofile", "list-org", "spark", "sbis", "zachestnyibiznes")

# Contact pages.
CONTACT_PATHS = ("contact", "contacts", "kontakty", "kontakti", "rekvizit", "requisites", "about", "company", "o-kompanii", "about-us")
CONTACT_WORDS = ("контакт", "реквизит", "о компании", "contacts", "contact", "about", "company")
COMMON_CONTACT_PATHS = (
    "/contacts/", "/contacts", "/kontakty/", "/kontakty", "/contact/", "/contact", "/about/", "/about",
    "/company/", "/company", "/requisites/", "/requisites", "/rekvizity/", "/rekvizity",
)
CONTACT_MINUS = ("privacy", "policy", "cart", "basket", "catalog", "product")

# Brands.
BRAND_STOPWORDS = (
    "professional", "professionnel", "laboratories", "laboratory", "lab", "home", "cosmetics", "cosmetic", "selection",
    "makeup", "moscow", "official", "russia", "россия", "kosmetika", "kosmetiki", "kosmeticheskaya",
)
BRAND_ALIASES = (
    (("trives",), ("trives-spb.ru", "trives-shop.ru")),
    (("черный", "жемчуг"), ("theblackpearl.ru",)),
    (("чёрный", "жемчуг"), ("theblackpearl.ru",)),
    (("юникосметик",), ("estel.beauty", "estel.pro")),
    (("юниккосметик",), ("estel.beauty", "estel.pro")),
    (("чистая", "линия"), ("chistayalinia.ru",)),
    (("невская", "косметика"), ("nevcos.ru",)),
    (("свобода",), ("svobodako.ru",)),
    (("compliment",), ("compliment.su",)),
    (("бабушка", "агаф"), ("1reshenie.ru",)),
    (("рецепты", "бабушки", "агаф"), ("1reshenie.ru",)),
    (("r.o.c.s",), ("rocs.ru",)),
    (("rocs",), ("rocs.ru",)),
)
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}

# Seller pages.
REQUISITE_MARKS = ("ИНН", "ОГРН", "ОГРНИП", "Номер регистрации", "КПП")
BLOCK_MARKS = ("ИНН", "ОГРН", "ОГРНИП", "КПП", "Номер регистрации", "УНП", "БИН", "ИИН", "Республика Беларусь", "Казахстан")
EMPTY_RESULTS = ("по вашему запросу ничего не найдено", "ничего не найдено", "ничего не нашлось", "nothing found", "no results found")
BLOCK_PAGES = ("Подозрительная активность", "Что-то не так", "Проверяем браузер", "Почти готово", "captcha-support@rwb.ru", "Новая попытка через")
IGNORED_NAMES = ("все товары", "главная", "адреса", "корзина", "франкфурт", "wildberries", "wibes")
SELLER_INFO_CLASSES = ("seller-details__tip-info", "seller-details__info-icon", "seller-info__info-icon", "seller-info")
RESTART_MARKS = ("failed to open a new tab", "target.createtarget", "target page, context or browser has been closed", "browser has been closed", "context has been closed")
RETRY_MARKS = ("timeout", "navigation", "net::err", "page.goto", "page.content", "page has been closed", "page is navigating")

#: Public suffixes of two labels that the engine knows; a table of more can be given instead.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.ru", "msk.ru", "spb.ru", "com.ua", "com.br", "com.au", "co.jp", "com.tr")
