"""Stop-word tables."""

# Function words and address fragments left out of scoring.
BASE_EN = tuple(
    """
    a about above after again against all am an and any are aren't as at be because been before being
    below between both but by can can't cannot could couldn't did didn't do does doesn't doing don't
    down during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's
    her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it
    it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought
    our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such
    than that that's the their theirs them themselves then there there's these they they'd they'll
    they're they've this those through to too under until up very was wasn't we we'd we'll we're we've
    were weren't what what's when when's where where's which while who who's whom why why's with won't
    would wouldn't you you'd you'll you're you've your yours yourself yourselves
    http https com org net www html amp
    """.split()
)

# Further words left out of word clouds only.
CLOUD_ONLY_EN = tuple("ever get also like just make time new way know one two see well much even us".split())

CLOUD_EN = BASE_EN + CLOUD_ONLY_EN

# Chinese function words.
STOP_ZH = tuple("的 了 在 是 我 有 和 就 不 人 都 一 一個 上 也 很 到 說 要 去 你 會 著 沒有 看 好 自己 這 那 以 或 對".split())

# Japanese function words; Japanese text shares the Chinese ones.
STOP_JA = tuple("ので のに こと もの ため よう ところ という として について のように です ます でした ました でしょう".split())
