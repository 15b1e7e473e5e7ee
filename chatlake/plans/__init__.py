"""chatlake.plans"""
