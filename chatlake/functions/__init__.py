"""chatlake.functions"""
