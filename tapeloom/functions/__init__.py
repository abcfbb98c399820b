from tapeloom.functions import news, prices, text, timing  # noqa: F401
