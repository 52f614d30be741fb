"""Words of chapter headings, for the expressions of `operators.pages` and the fold of `functions.page_layout`."""

# Ordinals before BÖLÜM and KISIM.
ORDINALS = (
    "BİRİNCİ", "İKİNCİ", "ÜÇÜNCÜ", "DÖRDÜNCÜ", "BEŞİNCİ", "ALTINCI", "YEDİNCİ", "SEKİZİNCİ", "DOKUZUNCU", "ONUNCU",
    "ON BİRİNCİ", "ON İKİNCİ", "ON ÜÇÜNCÜ", "ON DÖRDÜNCÜ", "ON BEŞİNCİ", "ON ALTINCI", "ON YEDİNCİ", "ON SEKİZİNCİ", "ON DOKUZUNCU",
    "YİRMİNCİ", "YİRMİ BİRİNCİ", "YİRMİ İKİNCİ",
)
# Words that no title begins with.
OPENERS = (
    "ve veya ile ama fakat çünkü ancak bu şu o ben sen biz siz bir her de da ki dedi diye sonra şimdi artık kadar olduğunu yaptığını istiyorsunuz düşünüyorsunuz"
).split()
