"""Vocabulary of receipts as ordered tables: labels, party headers, channels, status words, providers, banks, currencies.

Order is part of the meaning: where several entries fit, the first one counts. Users pass their own lists to the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values -----------------------------------------------------------------------------------------------------
FIELD_LABELS = {
    "amount": ["Amount", "Transfer Amount", "Total amount", "Amount Sent", "Transferred Amount", "Sent Amount", "المبلغ", "المبلغ المحول", "المبلغ الإجمالي المحول", "قيمة التحويل", "قيمة المعاملة", "المبلغ المرسل"],
    "fees": ["Fees", "Fee", "Transaction Fee", "Transaction Fees", "Service Fee", "Service Fees", "Commission", "رسوم", "الرسوم", "رسوم المعاملة", "رسوم الخدمة", "رسوم التحويل", "العمولة"],
    "total": ["Total", "Total Amount Deducted", "Total Deducted", "Amount Deducted", "Total Paid", "Grand Total", "المبلغ الكلي", "الإجمالي", "إجمالي المبلغ", "المبلغ المخصوم", "إجمالي المخصوم", "المبلغ المدفوع"],
    "reference": ["Reference", "Reference Number", "Reference No", "Ref", "Ref No", "Transaction ID", "Transaction Number", "Transaction No", "Transaction Reference", "Operation ID", "Receipt Number", "المرجع", "الرقم المرجعي", "رقم المرجع", "رقم العملية", "رقم المعاملة", "رقم التحويل", "رقم الإيصال"],
    "datetime": ["Date", "Time", "Date & Time", "Date and Time", "Transaction Date", "Transaction Time", "التاريخ", "الوقت", "التاريخ والوقت", "تاريخ العملية", "تاريخ المعاملة", "وقت العملية"],
    "note": ["Note", "Notes", "Purpose", "Description", "Comment", "Remarks", "Reason", "ملاحظة", "ملاحظات", "الغرض", "الوصف", "سبب التحويل"],
    "type": ["Transaction Type", "Service", "نوع العملية", "نوع المعاملة", "الخدمة"],
    "sender.name": ["Sender Name", "Payer Name", "From Name", "اسم المرسل", "اسم الراسل"],
    "sender.account": ["Sender Number", "Sender Account", "Sender Mobile", "From Account", "Wallet Number", "Your Wallet", "رقم المرسل", "حساب المرسل", "رقم المحفظة", "رقم محفظتك"],
    "receiver.name": ["Receiver Name", "Recipient Name", "Beneficiary Name", "To Name", "اسم المستقبل", "اسم المستلم", "اسم المستفيد", "اسم المرسل إليه"],
    "receiver.account": ["Receiver Number", "Recipient Number", "Receiver Mobile", "Recipient Mobile", "Receiver Account", "Beneficiary Account", "To Account", "رقم المرسل إليه", "رقم المستقبل", "رقم المستلم", "رقم المستفيد", "حساب المستفيد"],
}
PARTY_HEADERS = {
    "sender": ["From", "Sender", "Sent From", "Paid From", "من", "المرسل", "من حساب", "من محفظة"],
    "receiver": ["To", "Receiver", "Recipient", "Beneficiary", "Sent To", "Paid To", "إلى", "المستلم", "المستفيد", "المستقبل", "المرسل إليه"],
}
CHANNELS = ["Mobile Wallet", "Wallet", "Bank Account", "Account", "Card", "InstaPay", "IPA", "Mobile Number", "محفظة", "محفظة إلكترونية", "حساب بنكي", "حساب", "بطاقة", "انستاباي", "رقم موبايل"]
STATUS_WORDS = {
    "failed": ["failed", "failure", "declined", "rejected", "unsuccessful", "فشل", "فشلت", "مرفوض", "مرفوضة", "لم تتم"],
    "pending": ["pending", "in progress", "under review", "قيد التنفيذ", "قيد المعالجة", "جاري التنفيذ"],
    "success": ["success", "successful", "successfully", "completed", "approved", "بنجاح", "ناجحة", "تمت", "تم"],
}
#: Receipts that state the transfer in one sentence: party named, pattern; a space is any white space.
SENTENCES = [
    ("receiver", r"you (?:have )?(?:successfully )?(?:transferred|sent|paid) {amount} to {party}"),
    ("sender", r"you (?:have )?(?:successfully )?received {amount} from {party}"),
    ("receiver", r"تم (?:تحويل|ارسال|إرسال|دفع) (?:مبلغ )?{amount} (?:إلى|الى|الي|ل) ?{party}"),
    ("sender", r"تم استلام (?:مبلغ )?{amount} من {party}"),
]
#: Keywords of 4 or more Latin letters count inside a word too: logos glue glyphs on.
PROVIDERS = {
    "InstaPay": ["instapay", "انستاباي", "انستا باي"],
    "Axis": ["axis"],
    "Vodafone Cash": ["vodafone cash", "vodafone", "فودافون كاش", "فودافون"],
    "Orange Cash": ["orange cash", "orange money", "اورنج كاش"],
    "Etisalat Cash": ["etisalat cash", "e& cash", "e& money", "اتصالات كاش"],
    "WE Pay": ["we pay", "وي باي"],
    "Fawry": ["fawry", "myfawry"],
    "Meeza": ["meeza", "ميزة"],
    "Telda": ["telda"],
    "valU": ["valu"],
}
BANKS = ["CIB", "NBE", "QNB", "HSBC", "AAIB", "ADIB", "NBK", "SAIB", "FAB", "ENBD", "Emirates NBD", "Alex Bank", "Banque Misr", "Bank Misr", "Banque du Caire", "Arab African", "Credit Agricole", "Attijariwafa", "بنك مصر", "البنك الأهلي المصري", "البنك الأهلي", "بنك القاهرة", "البنك التجاري الدولي", "بنك الإسكندرية", "بنك قطر الوطني"]
CURRENCIES = {
    "EGP": ["EGP", "LE", "L.E", "E£", "ج.م", "ج م", "جم", "جنيه مصري", "جنيه", "جنية"],
    "USD": ["USD", "US$", "$", "دولار"],
    "EUR": ["EUR", "€", "يورو"],
    "SAR": ["SAR", "ريال سعودي", "ريال"],
    "AED": ["AED", "درهم"],
}
#: Least difflib ratio, and least normalised length, of a misspelt label.
FUZZY_RATIO, FUZZY_LENGTH = 0.85, 4
MONEY_FIELDS = ("amount", "fees", "total")
# ----------------------------------------------------------------------------------------------------------------------

_FOLD = str.maketrans("أإآٱىةؤئ", "اااايهوي")


def norm(text: str) -> str:
    """The comparison form of a short text; the same as functions.text.norm of a column."""
    kept = "".join(ch for ch in text.lower() if not "ً" <= ch <= "ْ" and ch != "ـ").translate(_FOLD)
    return " ".join("".join(ch if ch.isalnum() or ch in "_&" else " " for ch in kept).split())


def label_rows(fields: dict[str, list[str]] | None = None, headers: dict[str, list[str]] | None = None) -> list[tuple[str, str, str, int]]:
    """(norm, kind, target, ord): longest first, in the order given among equals; one row for each normalised label."""
    rows = [(norm(w), "field", t) for t, words in (FIELD_LABELS if fields is None else fields).items() for w in words]
    rows += [(norm(w), "party", t) for t, words in (PARTY_HEADERS if headers is None else headers).items() for w in words]
    rows.sort(key=lambda r: -len(r[0]))
    first: dict[str, tuple] = {}
    for k, (n, kind, target) in enumerate(rows):
        first.setdefault(n, (n, kind, target, k))
    return list(first.values())


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(label_rows(), "label string, kind string, target string, ord int")


def keyword_rows(groups: dict[str, list[str]]) -> list[tuple[str, str, int]]:
    """(name, keyword, ord) of a keyword table, the keywords normalised."""
    return [(name, norm(w), k) for k, (name, words) in enumerate(groups.items()) for w in words]
